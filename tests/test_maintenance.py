"""Batch table maintenance (T1-T8)."""

from __future__ import annotations

import random

import pytest

from shopfloor.operators import maintenance as mt


def test_append_validated_js_truthiness(spark):
    table = spark.createDataFrame([("r0", "a", 1)], "id string, name string, qty int")
    cand = spark.createDataFrame([("r1", "b", 2), ("r2", "", 3), ("r3", None, 4), ("r4", "c", 0)],
                                 "id string, name string, qty int")
    out, rej = mt.append_validated(table, cand, ["name", "qty"])
    assert sorted(r["id"] for r in out.collect()) == ["r0", "r1"]
    assert sorted(r["id"] for r in rej.collect()) == ["r2", "r3", "r4"]


def test_update_by_key_null_overwrites_and_unmatched(spark):
    table = spark.createDataFrame([("u1", "a", "x"), ("u2", "b", "y")], "id string, f string, g string")
    ch = spark.createDataFrame([("u1", "A", None), ("u9", "Z", "Z")], "id string, f string, g string")
    out, unmatched = mt.update_by_key(table, ch, "id", ["f", "g"])
    assert {r["id"]: (r["f"], r["g"]) for r in out.collect()} == {"u1": ("A", None), "u2": ("b", "y")}
    assert [r["id"] for r in unmatched.collect()] == ["u9"]


def test_insert_if_absent_first_request_wins(spark):
    hol = spark.createDataFrame([("h1", "2024-01-01", "1")], "holiday_id string, holiday_date string, company_id string")
    req = spark.createDataFrame([("q2", "2024-01-02", "1"), ("q1", "2024-01-02", "1"), ("q3", "2024-01-01", "1")],
                                "holiday_id string, holiday_date string, company_id string")
    out, rejected = mt.insert_if_absent(hol, req, ["holiday_date", "company_id"], "holiday_id")
    assert sorted(r["holiday_id"] for r in out.collect()) == ["h1", "q1"]
    assert sorted(r["holiday_id"] for r in rejected.collect()) == ["q2", "q3"]


SCHEMA = "holiday_id string, holiday_date string, company_id string"


def replay(stored, requests):
    """One request after the other: (table, accepted, rejected, unmatched numbers)."""
    table, ok, no, nobody = {k: (d, c) for k, d, c in stored}, [], [], []
    for n, k, d, c in sorted(requests):
        if k not in table:
            nobody.append(n)
        elif d is not None and c is not None and any(v == (d, c) for x, v in table.items() if x != k):
            no.append(n)
        else:
            ok.append(n)
            table[k] = (d, c)
    return table, ok, no, nobody


def in_order(spark, stored, requests):
    hol = spark.createDataFrame(stored, SCHEMA)
    ch = spark.createDataFrame(requests, "no int, " + SCHEMA)
    out, no, nobody, ok = mt.update_if_unique(hol, ch, "holiday_id", ["holiday_date", "company_id"],
                                              ["holiday_date", "company_id"], "no")
    numbers = lambda df: sorted(r["no"] for r in df.collect())
    return {r["holiday_id"]: (r["holiday_date"], r["company_id"]) for r in out.collect()}, numbers(ok), numbers(no), numbers(nobody)


def test_requests_for_unique_values_come_one_after_the_other(spark):
    stored = [("A", "d1", "1"), ("B", "d2", "1"), ("C", "d3", "1")]
    requests = [(1, "A", "d5", "1"), (2, "A", "d2", "1"), (3, "C", "d9", "1"), (4, "B", "d3", "1"), (5, "X", "d3", "1")]
    got = in_order(spark, stored, requests)
    assert got == replay(stored, requests)
    assert got[0] == {"A": ("d5", "1"), "B": ("d3", "1"), "C": ("d9", "1")} and got[1:] == ([1, 3, 4], [2], [5])


@pytest.mark.parametrize("seed", range(4))
def test_random_requests_for_unique_values(spark, seed):
    rnd = random.Random(seed)
    days = [f"d{i}" for i in range(14)]
    stored = [(f"h{i}", d, "1") for i, d in enumerate(rnd.sample(days, 9))] + [("n1", None, "1"), ("n2", None, "1")]
    hot = rnd.choice(days)
    requests = [(n, rnd.choice([f"h{rnd.randint(0, 9)}", "n1"]), hot if n % 3 == 0 else rnd.choice([*days, None]), "1")
                for n in range(1, 45)]
    assert in_order(spark, stored, requests) == replay(stored, requests)


def test_values_that_several_rows_hold(spark):
    stored = [("a", "d1", "1"), ("b", "d1", "1"), ("c", "d2", "1"), ("e", "d1", "2")]
    requests = [(1, "c", "d1", "1"), (2, "a", "d3", "1"), (3, "c", "d1", "1"), (4, "b", "d1", "1"), (5, "b", "d4", "1"),
                (6, "c", "d1", "1"), (7, "e", "d2", "1"), (8, "a", "d3", "1")]
    assert in_order(spark, stored, requests) == replay(stored, requests)


def test_a_hot_value_takes_few_rounds(spark, monkeypatch):
    rounds = []
    cut = mt._cut
    monkeypatch.setattr(mt, "_cut", lambda df: rounds.append(1) or cut(df))
    stored = [(f"h{i}", f"d{i}", "1") for i in range(200)]
    requests = [(i, f"h{i}", "hot", "1") for i in range(200)]
    assert in_order(spark, stored, requests) == replay(stored, requests)
    assert len(rounds) <= 2 + 4 * 2


def test_no_requests(spark):
    stored = [("a", "d1", "1")]
    assert in_order(spark, stored, []) == replay(stored, [])
    assert in_order(spark, [], [(1, "a", "d1", "1")]) == replay([], [(1, "a", "d1", "1")])


LOG = "no long, op string, id string, a string, b int"


def replay_log(stored, log):
    table, rejected = {k: (a, b) for k, a, b in stored}, []
    for n, op, k, a, b in sorted(log):
        if (k in table) == (op == "insert"):
            rejected.append(n)
        elif op == "delete":
            del table[k]
        else:
            table[k] = (a, b)
    return table, rejected


@pytest.mark.parametrize("seed", range(3))
def test_a_mixed_log_is_applied_in_order(spark, seed, monkeypatch):
    monkeypatch.setattr(mt, "LOG_BLOCK", 7)
    rnd = random.Random(seed)
    stored = [(f"k{i}", "old", i) for i in range(6)]
    log = [(n, rnd.choice(["insert", "update", "update", "delete"]), "k0" if n % 3 == 0 else f"k{rnd.randint(0, 9)}",
            rnd.choice([None, f"a{n}"]), n) for n in range(90)]
    out, rejected = mt.apply_log(spark.createDataFrame(stored, "id string, a string, b int"),
                                 spark.createDataFrame(log, LOG), "id", "no")
    assert ({r["id"]: (r["a"], r["b"]) for r in out.collect()}, sorted(r["no"] for r in rejected.collect())) == replay_log(stored, log)


def test_an_empty_log(spark):
    table = spark.createDataFrame([("k", "a", 1)], "id string, a string, b int")
    out, rejected = mt.apply_log(table, spark.createDataFrame([], LOG), "id", "no")
    assert out.collect() == table.collect() and rejected.count() == 0
    out, rejected = mt.apply_log(table.where("false"), spark.createDataFrame([(1, "insert", "q", "x", 2)], LOG), "id", "no")
    assert [tuple(r) for r in out.collect()] == [("q", "x", 2)] and rejected.count() == 0


def test_get_or_create_dim_is_deterministic(spark):
    dim = spark.createDataFrame([(1, "A")], "machine_type_id int, machine_type_name string")
    names = spark.createDataFrame([("A",), ("B",), ("B",), (None,)], "machine_type_name string")
    a = {r[1]: r[0] for r in mt.get_or_create_dim(dim, names, "machine_type_id", "machine_type_name").collect()}
    b = {r[1]: r[0] for r in mt.get_or_create_dim(dim, names, "machine_type_id", "machine_type_name").collect()}
    assert a == b and a["A"] == "1" and a["B"].startswith("T") and len(a) == 2


def test_update_guarded_owner_and_image_cascade(spark):
    machines = spark.createDataFrame(
        [("M1", "1", "old", "p", "m", "c", "l", 0.0, 0.0, 0, "c1"), ("M2", "2", "old", "p", "m", "c", "l", 0.0, 0.0, 0, "c1")],
        "machine_uid string, machine_id string, machine_name string, machine_plant string, machine_model string, "
        "machine_customer string, machine_location string, machine_longitude double, machine_latitude double, "
        "machine_type_id int, company_id string")
    parts = spark.createDataFrame([(1, "M1", "a.png"), (2, "M2", "b.png")], "machine_part_id bigint, machine_id string, machine_image_path string")
    types = spark.createDataFrame([(0, "T0")], "machine_type_id int, machine_type_name string")
    ch = spark.createDataFrame(
        [(1, "M1", "1", "older", "p", "m", "c", "l", 1.0, 1.0, "T0", "c1", "z.png"),
         (3, "M1", "1", "new", "p", "m", "c", "l", 1.0, 1.0, "T0", "c1", "z.png"),
         (2, "M2", "2", "new", "p", "m", "c", "l", 1.0, 1.0, "Fresh", "c9", "y.png")],
        "no int, machine_uid string, machine_id string, machine_name string, machine_plant string, machine_model string, "
        "machine_customer string, machine_location string, machine_longitude double, machine_latitude double, "
        "machine_type_name string, company_id string, machine_image string")
    m2, p2, t2, rejected = mt.update_guarded(machines, parts, types, ch, "no")
    assert m2.count() == 2 and [r["machine_uid"] for r in rejected.collect()] == ["M2"]
    names = {r["machine_uid"]: r["machine_name"] for r in m2.collect()}
    assert names == {"M1": "new", "M2": "old"}  # M2 names another owner
    assert {r["machine_id"]: r["machine_image_path"] for r in p2.collect()} == {"M1": "z.png", "M2": "b.png"}
    assert t2.count() == 2  # the requested new type exists even though the update was refused


def test_add_machine_creates_type_uid_and_part(spark):
    machines = spark.createDataFrame([("M1", "1", 0, "c1")], "machine_uid string, machine_id string, machine_type_id int, company_id string")
    parts = spark.createDataFrame([(1, "M1", "a.png")], "machine_part_id bigint, machine_id string, machine_image_path string")
    types = spark.createDataFrame([(0, "T0")], "machine_type_id int, machine_type_name string")
    new = spark.createDataFrame([("7", "n", "T0", "c1", "x.png"), ("8", "n", "T1", "c1", ""), ("9", "", "T1", "c1", "y.png")],
                                "machine_id string, machine_name string, machine_type_name string, company_id string, machine_image string")
    m, p, t = mt.add_machine(machines, parts, types, new)
    ids = {r.machine_id: (r.machine_uid, r.machine_type_id) for r in m.collect()}
    assert set(ids) == {"1", "7", "8"} and ids["7"][1] == "0" and ids["8"][1] == {r[1]: r[0] for r in t.collect()}["T1"]
    assert sorted((r.machine_id, r.machine_image_path) for r in p.collect()) == sorted([("M1", "a.png"), (ids["7"][0], "x.png")])


def test_reconcile_set_is_idempotent(spark):
    ops = spark.createDataFrame([("O1", "ann", "M1", "0", "1"), ("O2", "bob", "M1", "0", "1"), ("O3", "cid", "M2", "0", "1")],
                                "operator_id string, operator_name string, machine_id string, created_by string, company_id string")
    want = spark.createDataFrame([("M1", "ann", "0", "1"), ("M1", "dan", "0", "1")],
                                 "machine_id string, operator_name string, created_by string, company_id string")
    scope = spark.createDataFrame([("M1",)], "machine_id string")
    once, counts = mt.reconcile_set(ops, want, scope)
    assert sorted((r["machine_id"], r["operator_name"]) for r in once.collect()) == [("M1", "ann"), ("M1", "dan"), ("M2", "cid")]
    assert [(r["added"], r["deleted"]) for r in counts.collect()] == [(1, 1)]
    emptied, counts0 = mt.reconcile_set(ops, want.where("false"), spark.createDataFrame([("M2",)], "machine_id string"))
    assert sorted(r["operator_name"] for r in emptied.collect()) == ["ann", "bob"]
    assert [tuple(r) for r in counts0.collect()] == [("M2", 0, 1)]
    twice, counts2 = mt.reconcile_set(once, want, scope)
    assert sorted(map(tuple, twice.collect())) == sorted(map(tuple, once.collect()))
    assert [(r["added"], r["deleted"]) for r in counts2.collect()] == [(0, 0)]


def test_profile_left_join_keeps_users_without_company(spark):
    from types import SimpleNamespace

    from shopfloor.operators import catalog
    from shopfloor.params import Params
    users = spark.createDataFrame([("u1", "a", "b", "e", "d", "c1", 1, 0), ("u2", "a", "b", "e", "d", "c9", 1, 0)],
                                  "user_id string, first_name string, last_name string, personal_email string, "
                                  "designation string, company_id string, verified int, block int")
    comps = spark.createDataFrame([("c1", "Co", "m", "0", "x")],
                                  "company_id string, company_name string, company_email string, contact_no string, location string")
    t = SimpleNamespace(user_info=users, company_info=comps)
    inner = catalog.user_company_profile(t, Params())
    left = catalog.user_company_profile(t, Params(), how="left")
    assert [r["user_id"] for r in inner.collect()] == ["u1"]
    assert sorted((r["user_id"], r["company_name"]) for r in left.collect()) == [("u1", "Co"), ("u2", None)]


def test_json_delivery(spark):
    import json

    from shopfloor.sources.sinks import json_rows
    df = spark.createDataFrame([("M1", 1.5, None)], "machine_uid string, oee double, note string")
    row = json_rows(df, key="machine_uid").collect()[0]
    assert row["machine_uid"] == "M1" and json.loads(row["json"]) == {"machine_uid": "M1", "oee": 1.5}


def test_update_by_key_last_request_wins(spark):
    table = spark.createDataFrame([("u1", "a")], "id string, f string")
    ch = spark.createDataFrame([("u1", "x", 2), ("u1", "y", 1), ("u1", "z", 3)], "id string, f string, seq int")
    out, _ = mt.update_by_key(table, ch, "id", ["f"], order="seq")
    assert [(r["id"], r["f"]) for r in out.collect()] == [("u1", "z")]
