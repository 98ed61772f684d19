"""Surrogates of names under several titles, of IBANs, telephone numbers and addresses; and the whole query against a walk in Python."""

import re

import pytest

from evigraph.llm import pii


def replaced(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r for r in pii.replace(df, secret="s").collect()}


def mod97(v):
    v = v.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in v[4:] + v[:4])) % 97


def test_titles_are_no_part_of_a_name(spark):
    out = replaced(spark, "Mrs. Anna Smith met Ms Anna Smith and Mr. Anna Smith.", "Sra. Anna Smith", "Dr. John Brown, Sr. Pablo Ruiz, M. Jean Petit, Mme Petit, Prof. Dr. Hans Weber, Frau Dr. Braun")
    a, b, c = re.findall(r"(?:Mrs\.|Ms|Mr\.) (\w+ \w+)", out[0].text)
    assert a == b != c and a.split()[0].endswith("na") and not c.split()[0].endswith("na")
    assert out[1].text == f"Sra. {a}"
    assert not re.search("Anna|Smith|John|Brown|Pablo|Ruiz|Jean|Petit|Hans|Weber|Braun", " ".join(r.text for r in out.values()))
    assert out[2].n_entities == 6 and out[2].text.startswith("Dr. ") and ", Prof. Dr. " in out[2].text


def test_other_mentions_in_a_text_go_with_the_full_name(spark):
    out = replaced(spark, "Mrs. Anna Smith came. Anna Smith sat, ANNA SMITH spoke; Mrs. Smith and Dr. Anna Smith left. Smithson and Anna stayed, Smith too.", "Anna Smith is clear where no title names her.")
    first, last = re.match(r"Mrs\. (\w+) (\w+)", out[0].text).groups()
    assert out[0].text == f"Mrs. {first} {last} came. {first} {last} sat, {first.upper()} {last.upper()} spoke; Mrs. {last} and Dr. {first} {last} left. Smithson and Anna stayed, {last} too."
    assert out[0].n_entities == 3 and out[1].text == "Anna Smith is clear where no title names her."


def test_ibans_hold_their_checksum(spark):
    out = replaced(spark, "pay DE89 3704 0044 0532 0130 00 or DE89370400440532013000", "AB12 TEST WORD CAPS and DE88 3704 0044 0532 0130 00 stay")
    a, b = re.findall(r"DE[0-9]{2}[ 0-9]+[0-9]", out[0].text)
    assert a.replace(" ", "") == b != "DE89370400440532013000" and mod97(b) == 1 and len(a) == 27
    assert out[1].text == "AB12 TEST WORD CAPS and DE88 3704 0044 0532 0130 00 stay" and out[1].n_entities == 0


@pytest.mark.parametrize("number", ["(555) 123 4567", "0301234567", "030 1234567", "01 23 45 67 89", "+49 30 1234567"])
def test_telephone_numbers(spark, number):
    got = replaced(spark, f"call {number} now")[0]
    assert got.n_entities == 1 and number not in got.text
    assert re.sub(r"\d", "0", got.text) == re.sub(r"\d", "0", f"call {number} now")


def test_telephone_numbers_of_two_countries_are_two(spark):
    got = replaced(spark, "+49 301234567890 and +44 301234567890 and +1 337 555 7349 and (337) 555-7349")[0].text
    a, b, c, d = (re.sub(r"\D", "", x) for x in got.split(" and "))
    assert a.startswith("49") and b.startswith("44") and a[2:] != b[2:] and c == "1" + d


def test_versions_are_no_addresses(spark):
    assert replaced(spark, "use v1.2.3.4 or 1.2.3.4.5")[0].text == "use v1.2.3.4 or 1.2.3.4.5"


def test_names_of_odd_rows(spark):
    rows = [(None, "Mr. Bo Li and Bo Li"), (None, "Mr. Bo Li and Bo Li"), (1, None), (2, ""), (3, "Frau und " * 5), (4, "Mr. Bo Li. " * 3000 + "Li")]
    got = pii.replace(spark.createDataFrame(rows, "doc_id long, text string"), secret="s").collect()
    assert len(got) == 6 and not any(re.search(r"\bBo\b|\bLi\b", r.text or "") for r in got)
    assert {r.n_entities for r in got if r.doc_id == 4} == {3000} and {r.text for r in got if r.doc_id == 3} == {"Frau und " * 5}


def test_query_against_a_walk(spark):
    """All else of a text is as it was, one value has one surrogate, and no two values share one: over the whole table."""
    from evigraph.llm import queries

    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    kinds = {
        "email": r"[\w.%+\-]+@(?:[A-Za-z0-9\-]+\.)+[A-Za-z]{2,}", "secret": r"\b(?:sk-|pk-|ghp_|gho_|xox[abp]-|AKIA)[A-Za-z0-9_\-]{12,}|\b(?=\d*[a-f])(?=[a-f]*\d)[0-9a-f]{32,}\b",
        "ipv4": r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\d|\.\d)", "card": r"(?<!\d)\d{13,19}(?!\d)", "phone": r"\+1 \(\d{3}\) \d{3}-\d{4}",
    }
    luhn = lambda v: sum(c if i % 2 == 0 else sum(divmod(2 * c, 10)) for i, c in enumerate(map(int, reversed(v)))) % 10 == 0
    any_ = re.compile("|".join(f"(?P<{k}>{p})" for k, p in kinds.items()))
    to, n = {}, 0
    for r in queries.op7_pii_surrogates(spark, sf).collect():
        was = [m for m in any_.finditer(docs[r.doc_id] or "") if m.lastgroup != "card" or luhn(m[0])]
        assert r.n_entities == len(was) and r.kinds == ",".join(sorted({m.lastgroup for m in was}))
        if not was:
            assert r.text == docs[r.doc_id]
            continue
        ends = [0, *(x for m in was for x in m.span()), len(docs[r.doc_id])]
        rest = [docs[r.doc_id][a:b] for a, b in zip(ends[::2], ends[1::2])]
        got = re.fullmatch("(.*?)".join(map(re.escape, rest)), r.text, re.S)
        assert got, r.doc_id
        for m, new in zip(was, got.groups()):
            key = (m.lastgroup, m[0].lower() if m.lastgroup == "email" else m[0])
            assert new != m[0] and re.fullmatch(kinds[m.lastgroup], new) and to.setdefault(key, new) == new
            n += 1
    assert n and len({(k, s) for (k, _), s in to.items()}) == len(to)
