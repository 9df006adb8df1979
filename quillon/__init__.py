"""A PySpark-native engine for the data that language models are post-trained on."""
