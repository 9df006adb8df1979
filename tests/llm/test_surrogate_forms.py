"""Personal data in many forms: one person and one number however written, no time lost on odd texts."""

import itertools
import random
import re
import time

import pytest

from quillon.llm import surrogates


def shown(text, key=b"k"):
    """The text with every entity replaced by its first draw."""
    out, at = [], 0
    for a, b, kind in surrogates.entities(text):
        out += [text[at:a], surrogates.replaced(key, kind, text[a:b], {})]
        at = b
    return "".join([*out, text[at:]])


def found(text):
    return [(k, text[a:b]) for a, b, k in surrogates.entities(text)]


UNITS = [" ", "\n", "\t", "a", "Z", "A", "5", "f", "-", ".", ":", "=", "/", "+", "(", "0", "é", "Ж", "_", "Aa-", "Aa ", "A'", "1.", "1-", "12 ", "ab:", "x@", "@", "a.", "eyJ", "eyJ-", "sk-", "gh", "pwd=", "pwd:", "pwd='", 'pwd="', "token: ", "Mr ", "Dr. ", "Anna ", "Anna-", "earer ", "AB12", "AB12 ", "(0)", "::", "-----BEGIN PRIVATE KEY-----", "van "]
STARTS = ["", "-----BEGIN PRIVATE KEY-----", "Mr ", "a@", "pwd=", "eyJ"]


def test_time_grows_with_the_text():
    """Every start and run, and every pair of runs, at 10,000 and 100,000 characters: a pattern that read a run again from each of its places would take a hundred times as long."""
    rng = random.Random(1)
    pairs = [a + b for a, b in itertools.product(UNITS, UNITS)]
    for start, unit in itertools.chain(itertools.product(STARTS, UNITS), zip(itertools.cycle(STARTS), rng.sample(pairs, 60))):
        took = []
        for n in (10_000, 100_000):
            text = start + unit * (n // len(unit))
            began = time.perf_counter()
            for _, pattern, _ in surrogates._PATTERNS:
                for _ in pattern.finditer(text):
                    pass
            for pattern in (surrogates._NAME, surrogates._PERSON, surrogates._TOKEN):
                for _ in pattern.finditer(text):
                    pass
            took.append(time.perf_counter() - began)
        assert took[1] < 35 * max(took[0], 0.01), (start, unit, took)


@pytest.mark.parametrize("n", [1_500, 4_000, 200_000])
def test_a_key_without_an_end(n):
    for filler in (" ", "\n", "A\n"):
        text = "-----BEGIN PRIVATE KEY-----" + filler * n
        began = time.perf_counter()
        assert surrogates.entities(text) == [] and time.perf_counter() - began < 3
    assert found("-----BEGIN PRIVATE KEY-----\n\n MIIab12 \n\n-----END PRIVATE KEY-----") == [("secret", "MIIab12")]
    assert found("-----BEGIN PRIVATE KEY----- \n -----END PRIVATE KEY-----") == []


def test_titles_without_a_gender(spark):
    text = "Dr Anna Weber came. Anna Weber left."
    new = shown(text)
    name = re.fullmatch(r"Dr (\w+ \w+) came\. (\w+ \w+) left\.", new)
    assert name[1] == name[2] and name[1].split()[0] in surrogates.NAMES["latin", "f"]
    assert [x for _, x in found("Herr Doktor Weber und Frau Prof. Dr. Weber.")] == ["Weber", "Weber"]
    rows = [(1, "Mr Kofi Mensah spoke."), (2, "Dr Kofi Mensah spoke."), (3, "Mrs Toni Abara. Mr Toni Abara."), (4, "Dr Toni Abara."), (5, "Mrs Ayo Bello."), (6, "Prof Ayo Bello.")]
    got = {r.doc_id: r.text for r in surrogates.pseudonymised(spark.createDataFrame(rows, "doc_id long, text string"), b"k").collect()}
    assert got[1].split(" ")[1:] == got[2].split(" ")[1:] and got[5].split(" ")[1:] == got[6].split(" ")[1:]  # one gender in all the corpus
    assert len(set(re.findall(r"(?:Mrs|Mr|Dr) (\w+) ", f"{got[3]} {got[4]} "))) == 1
    assert got[1].split(" ")[1] in surrogates.NAMES["latin", "m"] and got[5].split(" ")[1] in surrogates.NAMES["latin", "f"]
    all_joined = {r.doc_id: r.text for r in surrogates.pseudonymised(spark.createDataFrame(rows, "doc_id long, text string"), b"k", to_all=-1).collect()}
    assert all_joined == got


def test_one_address_one_number():
    a, b, c = (shown(x) for x in ("Adam.Weber@Example.com", "adam.weber@example.com", "ADAM.WEBER@EXAMPLE.COM"))
    assert a.lower() == b == c.lower() and c.isupper() and b != "adam.weber@example.com" and a[0].isupper() and b.endswith(".com")
    digits = lambda t: re.sub(r"\D", "", t)
    one = [shown(x) for x in ("+1 555-123-4567", "+1-555-123-4567", "(555) 123-4567", "555.123.4567", "+15551234567")]
    assert [x[:3] for x in one[:2]] == ["+1 ", "+1-"] and len({digits(x)[-10:] for x in one}) == 1 and digits(one[2]) != "5551234567"
    two = [shown(x) for x in ("+49 (0)30 1234567", "030/1234567", "+49 30 1234567", "(030) 1234567")]
    assert len({digits(x)[-9:] for x in two}) == 1 and two[0].startswith("+49 (0)") and two[1][0] == "0" and digits(two[1]) != "0301234567"
    assert shown("4111 1111 1111 1111").replace(" ", "") == shown("4111111111111111")


def test_more_forms():
    iban = shown("DE89 3704 0044 0532 0130 00")
    assert iban.startswith("DE") and iban != "DE89 3704 0044 0532 0130 00" and surrogates._iban(iban) and iban.replace(" ", "") == shown("DE89370400440532013000")
    assert "iban" not in dict(found("AB12 3456 7890 1234 5678 and XX00ABCDEFGHIJKLMNOP"))  # check digits do not fit
    six = shown("see 2001:db8::8a2e:370:7334 now")
    assert "db8" not in six and len(six.split(" ")[1].split(":")) == 8 and six.split(" ")[1] == shown("2001:0db8:0:0:0:8a2e:0370:7334")
    assert found("at 12:30:45, std::vector, a::b, ::, 1:2:3") == []
    assert found('the password is hunter22, ok') == [("secret", "hunter22")] and found("the password is wrong") == [] and found("mon passphrase est “abc123”") == [("secret", "abc123")]
    assert found("on 12/2024 and 3/12345678 or 1999-2004") == []
