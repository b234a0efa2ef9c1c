"""Rendered pairs against plain Python."""
import random

import duckdb
import pandas as pd
from pyspark.sql import functions as F

from linkloom.llm import preference, queries
from linkloom.llm.preference import format_preferences, swapped_answers

TURNS = "pair_id LONG, side STRING, turn LONG, role STRING, text STRING"


def show(turns):
    return "".join(f"<|{r}|>\n{t}<|end|>\n" for r, t in turns)


def plain(chosen, rejected):
    clean = [[(r or "unknown", t or "") for _, r, t in sorted(x, key=lambda y: (y[0] is None, y[0] or 0, y[1] or "unknown", y[2] or ""))]
             for x in (chosen, rejected)]
    n = 0
    while n < min(map(len, clean)) and clean[0][n] == clean[1][n]:
        n += 1
    masks = []
    for side in clean:
        at, spans = 0, []
        for r, t in side[n:]:
            head = at + len(f"<|{r}|>\n")
            at = head + len(t) + len("<|end|>\n")
            if r == "assistant":
                spans.append((head, at))
        masks.append(spans)
    return show(clean[0][:n]), show(clean[0][n:]), show(clean[1][n:]), masks[0], masks[1]


def test_random_pairs(spark):
    rng = random.Random(6)
    pairs = {}
    for p in range(40):
        side = [(k, rng.choice(["user", "assistant", "system", None]), rng.choice(["a", "bb", "é😀", "", None])) for k in range(rng.randint(0, 6))]
        cut = rng.randint(0, len(side))
        pairs[p] = side, side[:cut] + [(k, rng.choice(["user", "assistant"]), rng.choice("xyz")) for k in range(cut, cut + rng.randint(0, 3))]
    rows = [(p, s, *t) for p, both in pairs.items() for s, side in zip(preference.SIDES, both) for t in side]
    rng.shuffle(rows)
    got = {r.pair_id: r for r in format_preferences(spark.createDataFrame(rows, TURNS)).collect()}
    assert set(got) == {r[0] for r in rows}
    for p, r in got.items():
        prompt, chosen, rejected, m1, m2 = plain(*pairs[p])
        assert (r.prompt, r.chosen, r.rejected) == (prompt, chosen, rejected)
        assert [tuple(x) for x in r.chosen_mask] == m1 and [tuple(x) for x in r.rejected_mask] == m2
        assert all(r.chosen[a:b].endswith("<|end|>\n") for a, b in m1)


def test_query_covers_every_conversation(spark, sf):
    got = queries.QUERIES["op5_chat_formatting"](spark, sf).toPandas()
    turns = pd.read_parquet(f"{sf}/conversations.parquet")
    assert sorted(got.pair_id) == sorted(turns.conv_id.unique())
    several = 0
    for r in got.itertuples():
        mine = turns[turns.conv_id == r.pair_id].sort_values("turn")
        assert r.prompt + r.chosen == show(zip(mine.role, mine.text))
        several += r.chosen_turns > 1
    assert several >= 10
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    want = con.sql(queries.TWINS["op5_chat_formatting"]).df()
    order = sorted(got.columns)
    assert sorted(map(tuple, got[order].values)) == sorted(map(tuple, want[order].values))


def test_odd_rows(spark):
    rows = [(1, "chosen", 0, "user", "q"), (1, "chosen", 0, "user", "q"), (1, "rejected", 0, "user", "q"),
            (2, "chosen", None, None, None), (None, "chosen", 0, "user", "x"), (3, None, 0, "user", "x"), (4, "other", 0, "user", "x"),
            (5, "chosen", 0, "assistant", "y" * 100_000), (5, "rejected", 0, "assistant", "y" * 100_000), (6, "rejected", 0, "user", "z")]
    df = spark.createDataFrame(rows, TURNS).withColumn("prompt", F.lit("old")).withColumn("_side", F.lit(1))
    got = {r.pair_id: r for r in format_preferences(df).collect()}
    assert set(got) == {1, 2, 5, 6}
    assert got[1].prompt_turns == 1 and got[1].chosen_turns == 1 and got[1].rejected_turns == 0
    assert got[2].chosen == "<|unknown|>\n<|end|>\n" and got[2].chosen_mask == []
    assert not got[5].differs and got[5].chosen == got[5].rejected == "" and len(got[5].prompt) > 100_000
    assert got[6].prompt == "" and got[6].rejected_turns == 1
    assert format_preferences(df.limit(0)).count() == 0
    convs = spark.createDataFrame([(0, None, "user", "a"), (0, 1, "assistant", None), (1, 0, "assistant", "b"), (1, 0, "assistant", "b"),
                                   (7, 0, None, "c"), (None, 0, "user", "d")], "conv_id LONG, turn LONG, role STRING, text STRING")
    got = {r.pair_id: r for r in format_preferences(swapped_answers(convs)).collect()}
    # Of two equal last answers one is swapped.
    assert got[1].rejected_turns == 2 and got[1].chosen_turns == 2 and got[1].prompt_turns == 0
    assert set(got) == {0, 1, 7} and got[0].rejected.startswith("<|assistant|>\nb<|end|>\n") and got[7].prompt_turns == 1
    assert swapped_answers(convs.limit(0)).count() == 0


def test_main_path_is_native(spark, sf):
    plan = queries.QUERIES["op5_chat_formatting"](spark, sf)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
