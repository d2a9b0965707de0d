import re

import pytest

from veilframe.llm import pii, queries

KEY = b"test"
SAMPLES = {
    "email": "write to Jo.hn-9@mail5.example.com now",
    "card": "paid 4111 1111 1111 1111, or 4316522678525456.",
    "iban": "to DE89 3704 0044 0532 0130 00 or GB82WEST12345698765432",
    "ssn": "number 123-45-6789 here",
    "phone": "call +1 (152) 555-3824, 212-555-0100 or +44 20 7946 0958",
    "ipv4": "from 10.0.0.255 and 1.2.3.4",
    "date": "on 2024-02-29, 31.12.1999, 12/31/2020, 31/12/2020, 01/02/2003 and 1999/01/01",
    "secret": 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"',
}
COUNTS = {"email": 1, "card": 2, "iban": 2, "ssn": 1, "phone": 3, "ipv4": 2, "date": 6, "secret": 1}
KEPT = ["4111 1111 1111 1112", "999.1.1.1", "2023-02-30", "000-12-3456", "1.2.3.4.5", "0000000000000000", "GB82WEST12345698765433", "3.14159, 10:30 and 2,000,000", "v1.2.3", "a@b", "٣٣٣-٤٤-٥٥٥٥"]


@pytest.mark.parametrize("kind", SAMPLES)
def test_kinds(kind):
    text, (there, back) = SAMPLES[kind], (pii.Permutation(KEY), pii.Permutation(KEY, -1))
    new, spans = pii.replace(text, there)
    assert {k for k, *_ in spans} == {kind} and len(spans) == COUNTS[kind]
    assert all(text[a:z] not in new for _, a, z in spans)
    assert pii.replace(new, back)[0] == text
    assert pii.replace(text, there) == (new, spans)
    assert pii.replace(text, pii.Permutation(b"other"))[0] != new


@pytest.mark.parametrize("text", KEPT)
def test_what_fails_validation_stays(text):
    assert pii.replace(text, pii.Permutation(KEY)) == (text, [])


def test_permutations_are_permutations():
    p, q = pii.Permutation(KEY), pii.Permutation(KEY, -1)
    for a, b in ((7, 9), (10, 10), (16, 3)):
        image = [p.number("x", v, a, b) for v in range(a * b)]
        assert sorted(image) == list(range(a * b))
        assert [q.number("x", v, a, b) for v in image] == list(range(a * b))


def test_query_round_trip(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    got = queries.queries()["op1_pii_pseudonyms"](spark, sf_dir)
    back = {r.doc_id: r.text for r in pii.restore(got.select("doc_id", "text"), pii.EXAMPLE_KEY).collect()}
    assert back == {r.doc_id: r.text for r in docs.collect()}
    changed = got.join(docs.withColumnRenamed("text", "old"), "doc_id").collect()
    assert sum(r.n_replaced for r in changed) > 0
    for r in changed:
        assert (r.text == r.old) == (r.n_replaced == 0)
        for s in r.spans:
            assert r.old[s.start : s.end] not in re.findall(r"[\w.+() -]+", r.text)


def test_edges(spark):
    rows = [(1, None, "a"), (None, "", "b"), (2, "x 1.2.3.4 " * 30_000, "c"), (2, "x 1.2.3.4", "c"), (2, "x 1.2.3.4", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kind string")
    got = pii.pseudonymise(docs, KEY)
    assert got.columns == ["doc_id", "text", "kind", "spans"]
    by = sorted(((r.text, len(r.spans)) for r in got.collect()), key=str)
    assert (None, 0) in by and ("", 0) in by and len(by) == 5
    assert len({t for t, n in by if n == 1}) == 1 and max(n for _, n in by) == 30_000
    assert pii.pseudonymise(docs.limit(0), KEY).count() == 0


CARD, IBAN = "4111111111111111", "ES9121000418450200051332"
CROWDED = {
    "4111 1111 1111 1111 123": (CARD, " 123"),
    "4111111111111111 123": (CARD, " 123"),
    "12 4111111111111111": ("12 ", CARD),
    "3 5500000000000004": ("3 ", "5500000000000004"),
    "12 4111 1111 1111 1111": ("12 ", CARD),
    "4111-1111-1111-1111-123": (CARD, "-123"),
    "41 1111 1111 111111 12": (CARD, " 12"),
    "ES91 2100 0418 4502 0005 1332 12": (IBAN, " 12"),
    "ES91 2100 0418 4502 0005 1332 PAID NOW": (IBAN, " PAID NOW"),
    "ES9121000418450200051332 AND": (IBAN, " AND"),
}


@pytest.mark.parametrize("text", CROWDED)
def test_short_tokens_beside_a_value(text):
    there, back = pii.Permutation(KEY), pii.Permutation(KEY, -1)
    new, spans = pii.replace(text, there)
    ((kind, a, z),) = spans
    value = next(x for x in CROWDED[text] if x[0] in "45E" and len(x) > 10)
    assert re.sub("[ -]", "", text[a:z]) == value and kind == ("iban" if value == IBAN else "card")
    assert text[:a] + text[z:] == next(x for x in CROWDED[text] if x != value)
    assert re.sub("[ -]", "", new[a:z]) == pii.replace(value, there)[0]  # equal values keep equal pseudonyms
    assert pii.replace(new, back)[0] == text


def test_crowded_values_are_restored():
    import random

    parts = ["4111 1111 1111 1111", "5500000000000004", "3782 822463 10005", "212-555-0100", "+44 20 7946 0958", "2024-02-29", "10.0.0.1"]
    parts += ["123-45-6789", "ES91 2100 0418 4502 0005 1332", "AB1", "+4", "+44", "1", "608", "123 4567", "+1 (152) 555-3824", "1 212 555"]
    draw, there, back = random.Random(7), pii.Permutation(KEY), pii.Permutation(KEY, -1)
    for _ in range(2000):
        text = draw.choice(" -").join(draw.choice(parts) for _ in range(draw.randint(1, 6)))
        new, spans = pii.replace(text, there)
        again, same = pii.replace(new, back)
        assert again == text and [k for k, *_ in same] == [k for k, *_ in spans]


def digit_sum(digits):
    """Luhn's sum, from its definition."""
    total = 0
    for i, c in enumerate(digits):
        d = int(c) * (2 if (len(digits) - i) % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return total


def is_value(kind, s):
    """Whether ``s`` is a value of the kind, by its definition."""
    import datetime

    d = re.sub(r"\D", "", s)
    if kind == "card":
        return 13 <= len(d) <= 19 and digit_sum(d) % 10 == 0 and len(set(d)) > 1
    if kind == "iban":
        plain = s.replace(" ", "")
        number = "".join(str(int(c, 36)) for c in plain[4:] + plain[:4])
        return 15 <= len(plain) <= 34 and int(number) % 97 == 1 and 2 <= int(plain[2:4]) <= 98
    if kind == "ssn":
        return d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"
    if kind == "ipv4":
        return all(o == str(int(o)) and int(o) < 256 for o in s.split("."))
    if kind == "date":
        for form in ("%Y-%m-%d", "%Y/%m/%d", "%d.%m.%Y", "%m/%d/%Y", "%d/%m/%Y"):
            try:
                return 1900 <= datetime.datetime.strptime(s, form).year <= 2099
            except ValueError:
                pass
        return False
    if s[0] == "+":
        return 8 <= len(d) <= 15 or (len(d) == 11 and d[0] == "1")
    body = d[-10:]
    return len(d) in (10, 11) and (len(d) == 10 or d[0] == "1") and body[0] > "1" and body[3] > "1"


SHAPES = {
    "iban": r"[A-Z]{2}\d\d( ?[A-Z0-9]{4}){2,7}( ?[A-Z0-9]{1,3})?", "ipv4": r"\d{1,3}(\.\d{1,3}){3}", "ssn": r"\d{3}-\d\d-\d{4}", "card": r"\d+([ -]\d+)*",
    "date": r"\d{4}-\d\d-\d\d|\d{4}/\d\d/\d\d|\d\d\.\d\d\.\d{4}|\d\d/\d\d/\d{4}",
    "phone": r"(\+?\d[ .-]?)?(\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}|\+\d{1,3}([ .-]?\(?\d{1,4}\)?){2,5}",
}


def brute_values(text):
    """Kind and text of the values, by trying every stretch of up to 60 characters; texts whose values touch others are skipped (None)."""
    found = []
    for kind, shape in SHAPES.items():
        for a, c in enumerate(text):
            if not (c.isdigit() or c in "+(" or ("A" <= c <= "Z" and kind == "iban")) or (a and (text[a - 1].isalnum() or (a > 1 and text[a - 2].isdigit() and text[a - 1] in ".-/"))):
                continue
            for z in range(min(len(text), a + 60), a + 6, -1):
                rest = text[z : z + 2]
                if rest[:1].isalnum() or (len(rest) == 2 and rest[0] in ".-/" and rest[1].isdigit()):
                    continue
                if re.fullmatch(shape, text[a:z], re.ASCII) and is_value(kind, text[a:z]):
                    found.append((a, z, kind))
                    break
    found += [(m.start(1), m.end(1), "secret") for m in re.finditer(r"(?i)(?:token|key|secret|password)[\"']?\s*[=:]\s*[\"']?([0-9a-f]{32,64})\b", text)]
    found += [(m.start(), m.end(), "email") for m in re.finditer(r"(?<![\w.%+-])[A-Za-z0-9](?:[A-Za-z0-9._%+-]*[A-Za-z0-9])?(?=@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)", text)]
    found.sort()
    if any(b[0] < a[1] for a, b in zip(found, found[1:], strict=False)):
        return None
    return [(kind, text[a:z]) for a, z, kind in found]


def test_all_documents_against_brute_force(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    compared = values = 0
    for r in queries.queries()["op1_pii_pseudonyms"](spark, sf_dir).collect():
        expected = brute_values(docs[r.doc_id] or "")
        if expected is not None:
            compared += 1
            values += len(expected)
            assert [(s.kind, docs[r.doc_id][s.start : s.end]) for s in r.spans] == expected, r.doc_id
    assert compared > 0.9 * len(docs) and values > 0


def test_dense_long_text_of_all_kinds():
    """Every value is found, decoys stay, and the time grows with the length."""
    import time

    p = pii.Permutation(KEY)

    def text(n):
        parts, want = [], []
        for i in range(n):
            for kind, value in (("email", f"user{i}"), ("phone", f"212-555-{i % 10_000:04d}"), ("card", CARD), ("date", "2024-02-29"), ("ipv4", f"10.{i % 256}.0.1"), ("iban", IBAN)):
                want.append((kind, value))
                parts.append(f"{value}@example.com" if kind == "email" else value)
            parts.append("000-12-3456 999.1.1.1 plain")
        return " , ".join(parts), want

    took = []
    for n in (250, 2000):
        t, want = text(n)
        began = time.process_time()
        new, spans = pii.replace(t, p)
        took.append(time.process_time() - began)
        assert [(k, t[a:z]) for k, a, z in spans] == want and new.count("000-12-3456") == n
    assert took[1] < 24 * took[0]


def test_clashing_names(spark):
    docs = spark.createDataFrame([("1.2.3.4", 1, "kept", "kept", "kept")], "text string, doc_id long, spans string, pii_made string, _pii_made string")
    (row,) = pii.pseudonymise(docs, KEY).collect()
    assert list(row.asDict())[:5] == docs.columns and row.spans == row.pii_made == row._pii_made == "kept"
    assert [s.kind for s in row["spans_"]] == ["ipv4"] and row.text != "1.2.3.4"
