import hashlib
import re

from shopfloor.llm import common, decontaminate
from tests.llm.helpers import documents, sf_documents

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UPPER))


def brute(docs, items):
    out = []
    for i, t in docs:
        w, hit, ids = words(t), set(), set()
        for item, x in items:
            b = words(x)
            k = min(10, len(b))
            for s in range(len(b) - k + 1 if k else 0):
                for p in range(len(w) - k + 1):
                    if w[p:p + k] == b[s:s + k]:
                        hit.update(range(p, p + k))
                        ids.add(str(item) if item is not None else "")
        out.append((i, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()))
    return sorted(out, key=repr)


def run(spark, docs, items, clashing=False):
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.decontaminate(documents(spark, docs, clashing), bench).collect()
    return sorted(((r.doc_id, r.n_words, r.n_hit, len(r["items"]), r.items_sha256) for r in got), key=repr)


ITEM = "One two three four five six seven eight nine ten eleven twelve"
DOCS = [(1, "x " + ITEM.upper() + " y"), (2, "one two three four five six seven eight nine TEN"), (3, ITEM[:-15]),
        (4, None), (5, ""), (6, "été! Été-2024 a b"), (7, "short item here"), (7, "short item here"),
        (None, "short, item"), (8, "the the the the the the the the the the the the"), (9, "ten eleven"),
        (10, (ITEM + ". ") * 300)]
ITEMS = [(10, ITEM), (9, "short item"), (9, "short item"), (3, "Été 2024"), (4, None), (5, "!!"), (6, "the " * 11),
         (None, "x one two three four five six seven eight nine"), (11, ITEM + " thirteen")]


def test_against_brute_force(spark):
    # str.upper changes é as well, which A-Z lower-casing must not undo
    assert run(spark, DOCS, ITEMS, clashing=True) == brute(DOCS, ITEMS)


def test_blocks_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 60)
    assert run(spark, DOCS, ITEMS) == brute(DOCS, ITEMS)


def test_empty_sides(spark):
    assert run(spark, [], ITEMS) == []
    assert run(spark, DOCS[:3], []) == brute(DOCS[:3], [])


def test_stage_drops_contaminated_rows_only(spark):
    df = documents(spark, DOCS + [(12, "clean words"), (7, "another text of seven")], clashing=True)
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    out = decontaminate.clean_documents(df, bench)
    assert out.columns == df.columns
    assert sorted((r.doc_id, r.text or "") for r in out.collect()) == [
        (3, ITEM[:-15]), (4, ""), (5, ""), (7, "another text of seven"), (9, "ten eleven"), (12, "clean words")]


def test_given_documents(spark):
    docs = sf_documents()[:40]
    items = [(k, " ".join(words(t)[5:40])) for k, t in docs[::7]]
    assert run(spark, docs, items) == brute(docs, items)


def test_one_worker_a_task(spark, monkeypatch):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    for size in (8 << 20, 60):  # one block, several
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", size)
        out = decontaminate.decontaminate(documents(spark, DOCS), bench)
        assert out._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1


def test_workers_end_their_tasks_small(monkeypatch):
    calls = []
    monkeypatch.setattr(common, "release_memory", lambda: calls.append("released"))
    assert list(common.lean(lambda batches: (b for b in batches))([1, 2])) == [1, 2]
    assert calls == ["released"]
