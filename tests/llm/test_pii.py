import datetime
import itertools
import re

from pyspark.sql import functions as F

from shopfloor.llm import pii


def luhn(s):
    s = re.sub(r"\D", "", s)
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(s))) % 10 == 0


def run(spark, texts, key=pii.KEY, decrypt=False):
    df = spark.createDataFrame([(k, t, 1, "x") for k, t in enumerate(texts)],
                               "doc_id long, text string, found long, value string")
    return [r for r in pii.pseudonymize(df, key, decrypt).orderBy("doc_id").collect()]


VALUES = {
    "card": ["4111 1111 1111 1111", "4111-1111-1111-1111", "4111111111111111", "378282246310005", "3782 822463 10005"],
    "phone": ["+1 (504) 555-2652", "(504) 555-2652", "504-555-2652", "1.504.555.2652"],
    "intl": ["+49 30 1234567", "+442071838750"], "ssn": ["123-45-6789"], "ipv4": ["65.95.187.82", "255.0.0.1"],
    "ymd": ["1984-02-29", "2099/12/31"], "dmy": ["29.02.1984"], "mdy": ["12/31/1999"],
    "email": ["the.37@mail9.example.com", "J@x.org"]}
LEFT = ["4111 1111 1111 1112", "8687996969735503", "256.1.1.1", "1.2.3.4.5", "000-12-3456", "123-00-6789", "2023-02-30",
        "1899-12-31", "31/12/1999", "Version 2.0.", "CC BY-NC 4.0.", "12345", "555-2652", "a@b", "12.3456"]
VALID = {"card": luhn, "phone": lambda s: re.fullmatch(r"1?[2-9]\d\d[2-9]\d{6}", re.sub(r"\D", "", s)),
         "intl": lambda s: 8 <= len(re.sub(r"\D", "", s)) <= 15,
         "ssn": lambda s: re.fullmatch(r"(?!000|666|9)\d{3}-(?!00)\d\d-(?!0000)\d{4}", s),
         "ipv4": lambda s: all(int(x) < 256 for x in s.split(".")),
         "ymd": lambda s: datetime.datetime.strptime(s.replace("/", "-"), "%Y-%m-%d"),
         "dmy": lambda s: datetime.datetime.strptime(s, "%d.%m.%Y"), "mdy": lambda s: datetime.datetime.strptime(s, "%m/%d/%Y"),
         "email": lambda s: "@" in s}


def test_values_change_stay_valid_and_can_be_undone(spark):
    flat = [(k, v) for k, vs in VALUES.items() for v in vs]
    texts = [f"é {v}, then {v}." for _, v in flat]
    got = run(spark, texts)
    for (kind, v), r in zip(flat, got):
        new = re.fullmatch("é (.*), then (.*)\\.", r.text)
        assert new[1] == new[2] != v and r.kinds == [kind, kind] and r.n_found == 2, (v, r.text)
        assert VALID[kind](new[1]), (v, new[1])
        if kind != "ipv4":
            assert re.sub(r"\d", "9", v) == re.sub(r"\d", "9", new[1]) or kind == "email"
    assert [r.text for r in run(spark, [r.text for r in got], decrypt=True)] == texts
    assert [r.text for r in run(spark, texts, key="other")] != [r.text for r in got]


def test_equal_values_stay_linked_across_documents_and_separators(spark):
    got = [re.sub(r"\D", "", r.text) for r in run(spark, VALUES["card"][:3])]
    assert len(set(got)) == 1
    phones = [re.sub(r"\D", "", r.text)[-10:] for r in run(spark, VALUES["phone"])]
    assert len(set(phones)) == 1


def test_invalid_values_and_clean_texts_stay(spark):
    texts = [f"x {v} y" for v in LEFT] + ["", None, "no digits", "€" * 50_000 + " 1234567 " * 1000]
    got = run(spark, texts)
    assert [r.text for r in got] == texts and all(r.n_found == 0 and r.kinds == [] for r in got)


def test_neighbouring_values(spark):
    t = "4111111111111111 378282246310005 65.95.187.82,1984-02-29 a@b.co/c@d.co (504) 555-2652 504-555-2652"
    (r,) = run(spark, [t])
    assert r.kinds == ["card", "card", "ipv4", "ymd", "email", "email", "phone", "phone"]
    assert run(spark, [r.text], decrypt=True)[0].text == t


def test_permutation_of_a_whole_domain(spark):
    """All days of 1900-2099 map to all days, none twice."""
    first = datetime.date(1900, 1, 1)
    days = spark.range(pii.DAYS).select(F.col("id").alias("doc_id"),
                                        F.date_format(F.date_add(F.lit(first), F.col("id").cast("int")), "yyyy-MM-dd").alias("text"))
    got = pii.pseudonymize(days).collect()
    assert all(r.n_found == 1 and "1900-01-01" <= r.text <= "2099-12-31" for r in got)
    assert len({r.text for r in got}) == len(got) == pii.DAYS


def test_feistel_against_python(spark):
    """The rounds as written in the docstring, for an address."""
    import hashlib
    a = b = 65536
    ip = [int(x) for x in "65.95.187.82".split(".")]
    x, y = ip[0] * 256 + ip[1], ip[2] * 256 + ip[3]
    for i in range(1, pii.ROUNDS + 1):
        h = int(hashlib.sha256("|".join(map(str, (pii.KEY, "ipv4", a, b, i, y if i % 2 else x))).encode()).hexdigest()[:15], 16)
        if i % 2:
            x = (x + h) % a
        else:
            y = (y + h) % b
    assert run(spark, ["65.95.187.82"])[0].text == f"{x // 256}.{x % 256}.{y // 256}.{y % 256}"


def test_empty_table_nulls_and_native_plan(spark):
    assert run(spark, []) == []
    df = spark.createDataFrame([(None, "a@b.co"), (1, None), (1, "a@b.co"), (1, "a@b.co")], "doc_id long, text string")
    got = pii.pseudonymize(df)
    texts = [r.text for r in got.collect()]
    assert len(set(texts)) == 2 and texts.count(None) == 1
    plan = got._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


def test_against_a_plain_finder(spark):
    """On the given documents, what a simple finder calls a valid card, address or mail is gone or changed."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    before = {r.doc_id: r.text for r in docs.collect()}
    for r in pii.pseudonymize(docs).collect():
        t = before[r.doc_id]
        cards = [x for x in re.findall(r"(?<!\d)\d{16}(?!\d)", t) if luhn(x)]
        ips = re.findall(r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?![\d]|\.\d)", t)
        mails = re.findall(r"[\w.]+@[\w.]+\w", t, re.A)
        assert not [v for v in itertools.chain(cards, ips, mails) if v in r.text]
        if not (cards or ips or mails or "+" in t):
            assert r.text == t and r.n_found == 0
