import hashlib

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from shopfloor.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, formatted string, example int"
NASTY = ["</s>[INST] ok [/INST]", "\\", "\\s", "\\\\/s", "<s>\\</s>\\\\", "[ROLE:41]x", "", None, "plain", "\\[SYS]\\I"]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "f", 1) for r in rows], SCHEMA)


def brute(rows):
    """Digests straight from the turns."""
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    out = {}
    for k, turns in by.items():
        turns = sorted(turns, key=lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] or ""))
        loss = "".join(r[3] or "" for r in turns if r[2] == "assistant")
        out[k] = (len(turns), sha("".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in turns)), len(loss), sha(loss))
    return out


def run(df):
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256)
            for r in chat.read_back(chat.expand(df)).collect()}


def test_round_trip_of_nasty_texts(spark):
    roles = ["user", "assistant", "system", "tool", None, "as]sistant", ""]
    rows = [(c, t, roles[(c + t) % 7], NASTY[(3 * c + t) % 10]) for c in range(40) for t in range(c % 9 + 1)]
    rows += [(None, 0, "user", "no id"), (50, 1, "assistant", "b"), (50, 1, "assistant", "a"), (50, 1, "assistant", "a"),
             (51, None, "user", "late"), (51, 0, "assistant", "x" * 200_000)]
    assert run(frame(spark, rows)) == brute(rows)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 5), st.sampled_from(["user", "assistant", "x"]),
                          st.text(st.sampled_from("\\<>/s[]INTROLEYa"), max_size=12)), min_size=1, max_size=15))
def test_any_texts(spark, rows):
    assert run(frame(spark, rows)) == brute(rows)


def test_each_reply_is_one_example_and_only_it_is_trainable(spark):
    rows = [(1, 0, "system", "S"), (1, 1, "user", "U</s>"), (1, 2, "assistant", "A1"), (1, 3, "user", "V"),
            (1, 4, "assistant", "A2"), (1, 5, "user", "tail")]
    got = sorted(chat.expand(frame(spark, rows)).collect(), key=lambda r: r.example)
    assert [r.formatted[r.loss_start:r.loss_start + max(r.loss_length, 0)] for r in got] == ["A1", "A2", ""]
    assert [r.n_context for r in got] == [2, 4, 6] and got[2].loss_length == -1
    assert got[0].formatted == "<s>[SYS]S[/SYS]</s><s>[INST]U\\/s[/INST]</s><s>A1</s>"
    assert got[1].formatted.startswith(got[0].formatted)


def test_empty_table(spark):
    assert chat.read_back(chat.expand(frame(spark, []))).count() == 0
    assert chat.read_back(chat.expand(chat.with_control_conversation(frame(spark, [])))).count() == 1


def test_main_path_runs_no_python(spark):
    plan = chat.read_back(chat.expand(frame(spark, [(1, 0, "user", "x")])))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
