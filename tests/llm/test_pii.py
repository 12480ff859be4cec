"""Pseudonyms keep format, validity and links between documents."""

import re

import pytest

from panelspark.llm import pii

ROWS = [
    (1, "call +1 (743) 555-3824 or 212-555-0187, card 4337166598464399 and 4337 1665 9846 4399."), (2, "card 4337166598464399; bad card 4337166598464398"),
    (3, "mail bosbt.42@mail8.example.com from 70.123.182.155, not 70.323.182.155"), (4, "born 1984-02-29, moved 3/14/1999, left 31.12.2005, never 31.02.2005"),
    (5, "ssn 123-45-6789, not 666-45-6789; iban GB82 WEST 1234 5698 7654 32 and DE89370400440532013000"), (6, "+49 30 901820"), (7, None), (8, ""), (9, "no values here"), (10, "70.123.182.155"),
]


@pytest.fixture(scope="module")
def made(spark):
    return {r.doc_id: r for r in pii.report(spark.createDataFrame(ROWS, "doc_id long, text string"), key="k").collect()}


def luhn(d):
    return sum(sum(divmod(int(c) * (2 if i % 2 else 1), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def iban(x):
    x = x.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97 == 1


def test_formats_and_validity(made):
    old = dict(ROWS)
    for i, r in made.items():
        shape = lambda t: re.sub("[0-9]+", lambda m: "9" * len(m[0]), t) if i not in (3, 10) else re.sub("[0-9]+", "9", re.sub(r"[a-z]+\.[0-9]+@", "a@", t))
        assert (r.text is None) == (old[i] is None) and (r.text is None or shape(r.text) == shape(old[i]))
    a, b = re.findall(r"[0-9]{16}|(?:[0-9]{4} ){3}[0-9]{4}", made[1].text)
    assert luhn(a) and a == b.replace(" ", "") and a in made[2].text and a != "4337166598464399" and "4337166598464398" in made[2].text
    assert "743" not in made[1].text.split("or")[0] and made[1].n_phone == 2 and made[1].n_card == 2 and made[2].n_card == 1
    assert "bosbt.42" not in made[3].text and "@mail8.example.com" in made[3].text and "70.323.182.155" in made[3].text and made[3].n_mail == made[3].n_ip == 1
    assert made[10].text in made[3].text and made[10].text != "70.123.182.155"
    assert "never 31.02.2005" in made[4].text and made[4].n_date == 3 and "-02-29" in made[4].text and "1984-02-29" not in made[4].text
    x, y = re.search(r"iban (.*) and (.*)", made[5].text).groups()
    assert iban(x) and iban(y) and x[5:9] == "WEST" and made[5].n_iban == 2 and made[5].n_ssn == 1 and "666-45-6789" in made[5].text
    assert made[6].text.startswith("+49 3") and made[6].text != "+49 30 901820" and [made[i].n_replaced for i in (7, 8, 9)] == [0, 0, 0]


def test_permutation(spark):
    """All values of a small domain map to different values of the domain, and another key gives another map."""
    docs = spark.range(2000).selectExpr("id as doc_id", "concat('10.9.', id div 256, '.', id % 256) as text")
    for key in ("k", "l"):
        new = [r.text for r in pii.report(docs, key=key).collect()]
        assert len(set(new)) == 2000 and all(max(map(int, x.split("."))) < 256 for x in new)
    days = spark.range(1200).selectExpr("id as doc_id", "cast(date_add(date'1999-01-05', cast(id as int)) as string) as text")
    new = [r.text for r in pii.report(days, key="k").collect()]
    assert len(set(new)) == 1200 and all(re.fullmatch(r"(19|20)\d\d-\d\d-\d\d", x) for x in new)


def test_rows_and_columns_stay(spark, odd_documents, no_documents):
    out = pii.pseudonymise(odd_documents, key="k")
    assert out.columns == odd_documents.columns and out.count() == odd_documents.count()
    assert sorted(map(repr, out.select("k1", "text").collect())) == sorted(map(repr, odd_documents.select("k1", "text").collect()))
    assert pii.pseudonymise(no_documents, key="k").count() == 0


def test_iban_before_capitals_and_other_numbers(spark):
    """What follows a number, capitals, a second number or a broken one, does not keep it in clear."""
    texts = ["DE89370400440532013000 BIC COBADEFFXXX", "DE89 3704 0044 0532 0130 00 FR14 2004 1010 0505 0001 3M02 606", "ZZ12 ABCD EFGH 1234 DE89 3704 0044 0532 0130 00 A1", "GB82 WEST 1234 5698 7654 32 IBAN"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in pii.report(docs, key="k").collect()}
    assert [got[i].n_iban for i in range(4)] == [1, 2, 1, 1]
    same = got[0].text.split(" ")[0]
    assert iban(same) and same != "DE89370400440532013000" and got[0].text.endswith(" BIC COBADEFFXXX")
    a, b = got[1].text[:27], got[1].text[28:]
    assert iban(a) and iban(b) and a.replace(" ", "") == same and b.startswith("FR")
    assert got[2].text == f"ZZ12 ABCD EFGH 1234 {a} A1" and iban(got[3].text[:27]) and got[3].text.endswith(" IBAN")


def test_long_repetitive_texts(spark):
    """Texts that make patterns repeat or backtrack as often as they can."""
    n = 100_000
    texts = ["a@" + "b." * n + "com", "a@b" + ".b" * 100 + ".com end", "a" * n, "a@" * n, "1" * n, "1-" * n, "1 " * n, "1." * n, "+1" * n, "+1 (" * n, "DE89 " * n, "DE" * n, "A1" * n, "2000-01-" * n, "@" * n, "a.b@c." * n]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in pii.report(docs, key="k").collect()}
    assert len(got) == len(texts) and got[0].text == texts[0]
    assert got[1].n_mail == 1 and got[1].text.endswith(".com end") and all(len(got[i].text) == len(t) for i, t in enumerate(texts))


def plain_number(key, kind, left, right, a, b):
    """The Feistel rounds of one value in plain Python."""
    import hashlib

    amount = lambda half, turn, x: int(hashlib.sha256(f"{key}|{kind}{half}|{turn}|{x}".encode()).hexdigest()[:15], 16)
    for turn in range(1, pii.ROUNDS + 1):
        left = (left + amount("l", turn, right)) % a
        right = (right + amount("r", turn, left)) % b
    return left, right


def test_against_plain_rounds(spark):
    docs = spark.createDataFrame([(1, "10.20.30.40 and 123-45-6789 and +49 30 901820")], "doc_id long, text string")
    got = pii.report(docs, key="k").first()
    left, right = plain_number("k", "ip", 10 * 256 + 20, 30 * 256 + 40, 65536, 65536)
    ip = f"{left // 256}.{left % 256}.{right // 256}.{right % 256}"
    left, right = plain_number("k", "ssn", (123 - 1) * 99 + 45 - 1, 6789 - 1, 898 * 99, 9999)
    area = left // 99
    ssn = f"{area + 2 if area >= 665 else area + 1:03d}-{left % 99 + 1:02d}-{right + 1:04d}"
    left, right = plain_number("k", "phone+", int("090"), int("1820"), 10**3, 10**4)
    digits = f"493{left:03d}{right:04d}"
    assert got.text == f"{ip} and {ssn} and +{digits[:2]} {digits[2:4]} {digits[4:]}"
