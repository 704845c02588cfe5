"""Chat formatting: exact round trips."""

import hashlib
import random
from itertools import groupby

import duckdb
from pyspark.sql import functions as F

from tessera.llm import chat as C

BITS = ["</s>", "<s>", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]", "[NEXT]", "<\\s>", "<\\\\/s>", "[\\NEXT]", "[", "<", "\\", "/s>", "NEXT]", "a", "é", "🙂", " ", "\n", "$1"]


def conversations(seed=1, n=60):
    rng = random.Random(seed)
    text = lambda: "".join(rng.choice(BITS) for _ in range(rng.randrange(12)))
    rows = [(c, t, rng.choice(["user", "assistant", "assistant", "tool", text(), None]), rng.choice([text(), None, ""])) for c in range(n) for t in range(rng.randrange(1, 9))]
    rows += [(0, 0, "user", "again"), (0, 0, "user", "again"), (None, None, "assistant", "x"), (None, 1, "assistant", "y"), (7, 100, "assistant", "long " * 50_000)]
    rng.shuffle(rows)
    return rows


def turns_of(rows):
    """conv_id -> [(role, text)] in order."""
    key = lambda r: (r[1] is not None, r[1] or 0, (r[2] or "").encode(), (r[3] or "").encode())
    out: dict = {}
    for r in sorted(((c, t, C_escape(r), C_escape(x)) for c, t, r, x in rows), key=key):
        out.setdefault(r[0], []).append((r[2], r[3]))
    return out


def C_escape(text):
    import re

    return re.sub(C.ESCAPE, r"\1\\\2\3", text or "")


def plain(text):
    import re

    return re.sub(C.UNESCAPE, r"\1\2\3", text)


def test_turns_and_loss_are_read_back(spark):
    rows = conversations()
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, turns int, pieces string")
    d = C.format_chats(frame)
    got = {r.conv_id: r for r in d.select("*", C.read_turns(F.col("formatted")).alias("turns"), C.learned_text(F.col("pieces")).alias("learned")).collect()}
    want = turns_of(rows)
    assert set(got) == set(want)
    for c, turns in want.items():
        r = got[c]
        told = [(plain(a), plain(b)) for a, b in turns]
        assert [tuple(t) for t in r.turns] == told and r.n_turns == len(told)
        assert r.learned == "".join(t for role, t in told if role == "assistant")
        assert "".join(p.text for p in r.pieces) == r.formatted
        merged = [(role, [t for _, t in g]) for role, g in groupby(turns, key=lambda t: t[0])]
        assert r.formatted == "".join(f"<s>[ROLE]{role}[/ROLE]{'[NEXT]'.join(texts)}</s>" for role, texts in merged)


def test_adjacent_turns_of_a_role_are_merged(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "assistant", "c"), (1, 3, "user", "d")]
    d = C.merged_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).first()
    assert [(m.role, m.texts) for m in d.merged] == [("user", ["a", "b"]), ("assistant", ["c"]), ("user", ["d"])]


def test_spans_cut_the_learned_texts_out(spark):
    rows = conversations(2)
    d = C.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).cache()
    formatted = {r.conv_id: r.formatted for r in d.collect()}
    spans: dict = {}
    for r in C.loss_spans(d).orderBy("start", "end").collect():
        spans.setdefault(r.conv_id, []).append(formatted[r.conv_id][r.start : r.end])
    learned = {c: "".join(t for role, t in turns if role == "assistant") for c, turns in turns_of(rows).items()}
    assert {c: "".join(spans.get(c, [])) for c in learned} == learned


def test_chat_plan_has_no_python(spark):
    plan = C.op13_chat_format(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_chats_of_little(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert C.format_chats(none).count() == 0


def test_chat_query(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    rows = [r for r in conversations(3) if r[0] is not None]
    cols = list(zip(*rows))
    pq.write_table(pa.table({"conv_id": pa.array(cols[0], pa.int64()), "turn": pa.array(cols[1], pa.int64()), "role": pa.array(cols[2], pa.string()), "text": pa.array(cols[3], pa.string())}), tmp_path / "conversations.parquet")
    got = C.op13_chat_format(spark, str(tmp_path))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    planted = [(-1, 0, "user", C.PLANTED), (-1, 1, "assistant", C.PLANTED)]
    want = []
    for c, turns in turns_of([*rows, *planted]).items():
        told = [(plain(a), plain(b)) for a, b in turns]
        loss = "".join(t for role, t in told if role == "assistant")
        heads = sum(i == 0 or turns[i - 1][0] != t[0] for i, t in enumerate(turns))
        chars = sum(len(t) for _, t in turns) + sum(len(g) + len("<s>[ROLE][/ROLE]</s>") for g, _ in groupby(t[0] for t in turns)) + 6 * (len(turns) - heads)
        want.append((c, len(told), sha("".join(f"{a}\n{b}\n" for a, b in told)), len(loss), sha(loss), chars))
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_chat_sql(spark):
    path = "/root/testdata/sf0.001"
    db = duckdb.connect()
    db.execute(f"CREATE VIEW conversations AS SELECT * FROM '{path}/conversations.parquet'")
    want = db.execute(C.ORACLES["op13_chat_format"])
    names = [x[0] for x in want.description]
    d = C.op13_chat_format(spark, path)
    assert d.columns == names and sorted(tuple(r) for r in d.collect()) == sorted(want.fetchall())
