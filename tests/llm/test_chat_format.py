import hashlib
import random

from hypothesis import given
from hypothesis import strategies as st

from textquarry.llm import chat_format as C

TEXT = st.lists(st.sampled_from([*"<[\\/sINST]|>turnend\n é", "</s>", "<|end|>", "[INST]", "<|turn|>"]), max_size=40).map("".join)


@given(TEXT)
def test_escape_is_exact_and_leaves_no_control_string(text):
    out = C.escape(text)
    assert C.unescape(out) == text
    assert not any(c in out for c in C.CONTROL)
    assert C.unescape_role(C.escape_role(text)) == text and "\n" not in C.escape_role(text)


@given(st.lists(st.tuples(st.binary(max_size=5), st.binary(max_size=9)), min_size=1, max_size=8))
def test_assemble_is_concatenation(rows):
    out, at = C.assemble([[a for a, _ in rows], [b for _, b in rows]])
    assert out.tobytes() == b"".join(a + b for a, b in rows)
    assert [out[at[k] : at[k + 1]].tobytes() for k in range(len(rows))] == [a + b for a, b in rows]


def digest(turns):
    said = "".join(t for r, t in turns if r == "assistant")
    return (
        len(turns),
        hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(),
        len(said),
        hashlib.sha256(said.encode()).hexdigest(),
        sum(len(f"{C.TURN}{C.escape_role(r)}\n{C.escape(t)}{C.END}") for r, t in turns),
    )


def test_digests_equal_brute_force_over_small_batches(spark):
    rng = random.Random(5)
    rows = [(c, t, rng.choice(["user", "assistant", "system", None, "odd\nrole"]), rng.choice([None, "", "été </s>[INST] ok [/INST]", "a\\b <\\s> <s>"])) for c in range(12) for t in range(rng.randint(1, 30))]
    rows += [(3, 0, "assistant", "again"), (3, 0, "assistant", "again"), (None, 1, "user", "no id"), (5, None, "user", "no turn"), (-1, 0, "user", "</s>")]
    rows = [(*r, 1) for r in rows]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, part int")
    groups = {}
    for c, t, r, x, _ in rows:
        groups.setdefault(c, []).append(((t is not None, t or 0), r or "", x or ""))
    expected = {c: digest([(r, x) for _, r, x in sorted(v)]) for c, v in groups.items()}
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for n in ("10000", "3"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", n)
            parts = C.format_conversations(df)
            got = {r["conv_id"]: tuple(r)[1:] for r in C.digest_parts(parts).collect()}
            assert got == expected
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)


def test_loss_covers_assistant_texts_alone(spark):
    df = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "a <s> b")], "conv_id bigint, turn bigint, role string, text string")
    row = C.format_conversations(df).first()
    assert [C.unescape(row["formatted"][s["start"] : s["end"]]) for s in row["loss"]] == ["a <s> b"]
    assert C.parse(row["formatted"]) == [("user", "q"), ("assistant", "a <s> b")]


def test_empty_table(spark):
    df = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert C.digest_parts(C.format_conversations(df)).count() == 0
