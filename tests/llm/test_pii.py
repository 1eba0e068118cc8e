"""PII surrogates: detection, format, coreference, distinctness, clean texts."""

import re

from cohortlens.llm import pii

TEXT = ("Mr. John Smith (john.smith@mail.example.com) met Mrs. Smith. Card 4111 1111 1111 1111, then 4111111111111111; SSN 123-45-6789. "
        "Call +1 (743) 555-3824 or 743-555-3824. Host 10.0.0.17, token = \"24be64439e3e49cf46b2d7c90f3602a3d0b907ff\", IBAN DE89 3704 0044 0532 0130 00. Frau ERNA MÜLLER")
CLEAN = "In 1999-2003 there were 12345 rows, 3.14 and 2020-01-15, version 1.2.3; chapter 10.2.3.4.5 and Mr who? a@b"


def apply(spark, rows, **kw):
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as id", "'x' as kind")
    return {r.doc_id: r for r in pii.replace(df, **({"key": b"a key"} | kw)).collect()}


def test_types_formats_and_coreference(spark):
    got = apply(spark, [(1, TEXT), (2, TEXT), (3, CLEAN), (4, None), (5, ""), (6, "again john.smith@mail.example.com"), (7, "x " * 100_000 + "10.0.0.17")])
    t = got[1].text
    assert got[2].text == t and got[3].text == CLEAN and got[4].text is None and got[5].text == ""
    assert got[3].n_entities == got[4].n_entities == got[5].n_entities == 0
    for secret in ("John", "Smith", "john.smith", "4111", "123-45-6789", "555-3824", "10.0.0.17", "24be64", "3704 0044", "ERNA", "MÜLLER"):
        assert secret not in t
    m = re.fullmatch(r"Mr\. ([A-Z][a-z]+) ([A-Z][a-z]+) \(([a-z]+\.[a-z]+@[a-z]+\.[a-z]+\.com)\) met Mrs\. ([A-Z][a-z]+)\. Card (\d{4} \d{4} \d{4} \d{4}), then (\d{16}); SSN (\d{3}-\d\d-\d{4})\. "
                     r"Call \+1 (\(\d{3}\) \d{3}-\d{4}) or (\d{3}-\d{3}-\d{4})\. Host (\d+\.\d+\.\d+\.\d+), token = \"([0-9a-f]{40})\", IBAN (DE\d\d \d{4} \d{4} \d{4} \d{4} \d\d)\. Frau ([A-Z]+A) ([A-Z]+)", t)
    assert m, t
    assert m[2] == m[4]  # the surname
    assert m[1][-1] != "a"  # gender of the form of address
    assert m[5].replace(" ", "") == m[6] and pii.luhn(m[6])
    assert re.sub(r"\D", "", m[8]) == m[9].replace("-", "")
    assert got[6].text == "again " + m[3]
    assert got[7].text.endswith(m[10])
    spans = [(s["kind"], TEXT[s["lo"]: s["hi"]]) for s in got[1].spans]
    assert ("email", "john.smith@mail.example.com") in spans and ("iban", "DE89 3704 0044 0532 0130 00") in spans
    assert apply(spark, [(1, TEXT)], key=b"other")[1].text != t


def found(text):
    return [(k, text[a:b]) for a, b, k, _ in pii.mentions(text)]


def test_bare_mentions_of_a_detected_name():
    text = "Smith came. Mr. John Smith (Smith@x.org, John.Smith@x.org) spoke; then SMITH's wife and John left, a smith stayed, Smithson too."
    assert found(text) == [("surname", "Smith"), ("given-m", "John"), ("surname", "Smith"), ("email", "Smith@x.org"), ("email", "John.Smith@x.org"),
                           ("surname", "SMITH"), ("given-m", "John")]
    assert len({c for _, _, k, c in pii.mentions(text) if k == "surname"}) == 1
    assert found("Smith and John went.") == []


def test_initials_apostrophes_particles():
    assert found("Dr. J. Smith, Mr. O'Neil and Mr. de Gaulle") == [("surname", "Smith"), ("surname", "O'Neil"), ("surname", "Gaulle")]
    assert found("Herr Ludwig van Beethoven; Mrs. J. R. Ewing's car; O'Neil.") == [("given-m", "Ludwig"), ("surname", "Beethoven"), ("surname", "Ewing")]
    assert found("Mr. O’Neil said. O’Neil left.") == [("surname", "O’Neil")] * 2


def test_two_series_cards_spaced_phones_and_ip6():
    assert pii.luhn("2223003122003222")
    assert found("Pay 2223 0031 2200 3222 or 2223003122003222, not 2223003122003223") == [("card", "2223 0031 2200 3222"), ("card", "2223003122003222")]
    assert found("Call 743 555 3824, or 1 743 555 3824; 100 200 3000 rows") == [("phone", "743 555 3824"), ("phone", "1 743 555 3824")]
    a, b = pii.mentions("Host 2001:db8::8a2e:370:7334 is 2001:0DB8:0:0:0:8A2E:0370:7334.")
    assert a[2:] == b[2:] == ("ip6", "2001:0db8:0000:0000:0000:8a2e:0370:7334")
    assert found("At 12:30:45, 00:1a:2b:3c:4d:5e, std::vector, a ratio of 1:2:3 and ::") == []


def test_collisions_are_resolved(spark, monkeypatch):
    first = pii.surrogate
    # every first attempt for an SSN is the same, and the second try of one is an entity of the corpus
    monkeypatch.setattr(pii, "surrogate", lambda key, kind, canon, attempt: "987654321" if kind == "ssn" and attempt == 0 else first(key, kind, canon, attempt))
    entities = spark.createDataFrame([("ssn", f"{i:09d}") for i in range(100, 130)] + [("ip", "1.2.3.4"), ("ssn", "987654321")], "kind string, canon string")
    from cohortlens.llm.tables import Scratch

    rows = pii.distinct_surrogates(entities, b"k", Scratch(spark)).collect()
    new = [r.new for r in rows if r.kind == "ssn"]
    assert len(rows) == 32 and len(set(new)) == 31
    assert not set(new) & {r.canon for r in rows if r.kind == "ssn"}


def test_empty_table_and_scripts(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert pii.replace(df, key=b"k").count() == 0
    t = "господин Иван Петров"
    out = "".join(pii.render(k, t[a:b], pii.surrogate(b"k", k, c, 0)) for a, b, k, c in pii.mentions(t))
    assert all("а" <= c.lower() <= "я" for c in out)


def test_colliding_domains_and_used_up_formats(spark):
    """52 addresses on two domains of one letter, and all 26 one-letter domains, end with distinct surrogates."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    key = next(k for k in (str(i).encode() for i in range(10**4)) if pii.surrogate(k, "domain", "a.co", 0) == pii.surrogate(k, "domain", "v.co", 0))
    some = [f"{c}@{d}.co" for c in letters for d in "av"]
    got = apply(spark, [(i, m) for i, m in enumerate(some)] + [(99, " ".join(some))], key=key)
    new = [got[i].text for i in range(52)]
    assert len(set(new)) == 52 and got[99].text == " ".join(new)
    assert len({x.split("@")[1] for x in new}) == 2  # addresses of one domain stay together
    every = [f"{c}@{d}.co" for c in "abc" for d in letters]
    new = [r.text for r in apply(spark, list(enumerate(every)), key=key).values()]
    assert len(set(new)) == 3 * 26 and len({x.split("@")[1] for x in new}) == 26


def until(attempt, same):
    """A step that gives every entity one surrogate up to an attempt (closures reach the workers by value)."""
    def run(batches):
        import pyarrow as pa
        from cohortlens.llm import pii
        for b in batches:
            new = [same if a <= attempt else pii.surrogate(b"k", k, c, a) for k, c, a in zip(*(x.to_pylist() for x in b.columns))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(new, pa.string())], names=["kind", "canon", "attempt", "new"])
    return lambda key: run


def test_formats_that_cannot_grow_fail_instead_of_sharing(spark, monkeypatch):
    import pytest
    from cohortlens.llm.tables import Scratch
    monkeypatch.setattr(pii, "MOST", 3)
    monkeypatch.setattr(pii, "_named", until(10, "1"))
    with pytest.raises(ValueError, match="ssn"):
        pii.distinct_surrogates(spark.createDataFrame([("ssn", "123456789"), ("ssn", "123456788")], "kind string, canon string"), b"k", Scratch(spark))


def test_one_person_has_one_name():
    kinds = lambda text: [(k, c) for _, _, k, c in pii.mentions(text)]
    assert set(kinds("Dr. Robin Smith left. Mrs. Robin Smith came.")) == {("given-f", "robin"), ("surname", "smith")}
    assert set(kinds("Mr. Robin spoke, then Mr. Robin Smith; Robin left.")) == {("given-m", "robin"), ("surname", "smith")}
    assert kinds("Mr. Kim Lee and Mrs. Kim Lee") == [("given-m", "kim"), ("surname", "lee"), ("given-f", "kim"), ("surname", "lee")]


def test_given_names_and_surnames_share_no_surrogate(spark, monkeypatch):
    from cohortlens.llm.tables import Scratch
    monkeypatch.setattr(pii, "_named", until(0, "bado"))
    names = [("given-m", "john"), ("given-f", "mary"), ("surname", "john"), ("surname", "smith")]
    rows = pii.distinct_surrogates(spark.createDataFrame(names, "kind string, canon string"), b"k", Scratch(spark)).collect()
    assert len({r.new for r in rows}) == 4
