import duckdb
import pytest

from tessella.llm import quotes
from tessella.llm.queries import QUERIES, SQL
from tessella.llm.quotes import latest_before, link_quotes
from tests.oracle import assert_same, connect

TALK = [
    (1, 0, "user", "How do I sort a list?\nIt is long."),
    (1, 1, "assistant", "Use sort().\nIt is stable."),
    (1, 2, "user", "> Use  SORT().\n>\n> It is stable.\nAnd in reverse?"),
    (1, 3, "user", "On Monday, Ann wrote:\n> How do I sort a list?\nI wonder too."),
    (1, 4, "assistant", ">> How do I sort a list?\n> I wonder too.\nSee above."),
    (1, 5, "user", "> something nobody said\nHm."),
    (2, 7, "user", "Use sort()."),
    (2, 8, "user", "Nothing like it."),
    (2, 9, "user", "> Use sort().\n> not this\nNo."),
    (2, 10, "user", "> Nothing like it.\n> Yes, and\n> nothing like it.\nYes."),
]
SCHEMA = "conv_id long, turn long, role string, text string"


def linked(spark, rows, schema=SCHEMA):
    return {(r.conv_id, r.turn): r for r in link_quotes(spark.createDataFrame(rows, schema)).collect()}


def test_quotes_lead_to_their_messages(spark):
    out = linked(spark, TALK)
    parents = {k: (r.parent_turn, r.linked) for k, r in out.items()}
    assert parents == {(1, 0): (None, False), (1, 1): (0, False), (1, 2): (1, True), (1, 3): (0, True), (1, 4): (3, True), (1, 5): (4, False), (2, 7): (None, False), (2, 8): (7, False), (2, 9): (8, False), (2, 10): (8, True)}
    assert out[1, 2].text == "And in reverse?" and out[1, 3].text == "I wonder too." and out[1, 4].text == "See above."
    assert (out[1, 4].quote_depth, out[1, 4].quoted_passages, out[1, 4].linked_passages) == (2, 2, 2)
    assert {k: (r.thread_turn, r.reply_depth) for k, r in out.items()} == {(1, 0): (0, 0), (1, 1): (0, 1), (1, 2): (0, 2), (1, 3): (0, 1), (1, 4): (0, 2), (1, 5): (0, 3), (2, 7): (7, 0), (2, 8): (7, 1), (2, 9): (7, 2), (2, 10): (7, 2)}


def test_equals_its_sql(spark, small):
    assert_same(QUERIES["op1_quotation_linking"](spark, small), connect(small), SQL["op1_quotation_linking"])
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", TALK)
    assert_same(link_quotes(spark.createDataFrame(TALK, SCHEMA)), con, SQL["op1_quotation_linking"])


def quoting(rng, conversations):
    """Conversations whose messages quote earlier ones: whole, in part, nested, broken anew, edited, with lines that many share."""
    common = ["Thanks", "Hi", "Yes.", "See below"]

    def line():
        return rng.choice(common) if rng.random() < 0.4 else " ".join(rng.choice(["alpha", "Beta", "gamma", "x1", "y2"]) for _ in range(rng.randint(1, 7)))

    rows = []
    for c in range(conversations):
        texts = []
        for t in range(rng.randint(2, 30)):
            out = []
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                if not texts:
                    break
                lines = rng.choice(texts).split("\n")
                kind = rng.random()
                if kind < 0.4:
                    a = rng.randrange(len(lines))
                    lines = lines[a : a + rng.randint(1, 4)]
                elif kind < 0.5:
                    lines = " ".join(lines).split(" ")
                elif kind < 0.65:
                    lines[rng.randrange(len(lines))] = line()
                if rng.random() < 0.3:
                    out.append("Ann wrote:")
                mark = rng.choice(["> ", ">", ">> ", "> > "])
                out += [mark + (x.upper() if rng.random() < 0.1 else x) for x in lines]
                if rng.random() < 0.7:
                    out += [line() for _ in range(rng.randint(1, 3))]
            out += [line() for _ in range(rng.randint(0 if out else 1, 5))]
            texts.append("\n".join(out))
            rows.append((c, 2 * t + rng.randint(0, 1), "u", texts[-1]))
    return rows


@pytest.mark.parametrize("seed, conversations", [(1, 60), (2, 650)])
def test_quoting_conversations_equal_the_sql(spark, tmp_path, seed, conversations):
    import random

    rows = quoting(random.Random(seed), conversations)
    df = spark.createDataFrame(rows, SCHEMA)
    df.write.parquet(f"file:{tmp_path}/conversations")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations/*.parquet'")
    out = link_quotes(df)
    assert_same(out, con, SQL["op1_quotation_linking"])
    if seed == 2:
        told = con.execute(f"SELECT count(*), count(*) FILTER (linked), count(*) FILTER (linked_passages < quoted_passages) FROM ({SQL['op1_quotation_linking']})").fetchone()
        assert told[0] >= 10_000 and told[1] > 3000 and told[2] > 100


def test_the_message_with_the_whole_excerpt_wins_over_later_ones_with_common_lines(spark):
    rows = [(1, 1, "u", "Alpha\n\nThanks\nmore"), (1, 2, "u", "Thanks"), (1, 3, "u", "> alpha\n> Thanks\nHm"), (1, 4, "u", "Hi"), (1, 5, "u", "> alpha\n>\n> thanks\n> more\nAgain")]
    out = linked(spark, rows)
    assert (out[1, 3].parent_turn, out[1, 5].parent_turn) == (1, 1)


def test_messages_are_told_apart_by_row(spark):
    rows = [(1, 1, None, "> hello there\nmine"), (1, 1, "> hello there\nmine", None)]
    out = link_quotes(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.role or "", r.text, r.quoted_passages) for r in out) == [("", "mine", 1), ("> hello there\nmine", "", 0)]


def test_the_latest_earlier_message_counts(spark):
    rows = [(1, t, "u", "same line") for t in (0, 300, 700)] + [(1, 600, "u", "> same line\nyes"), (1, 5, "u", "> same line"), (1, 900, "u", "> later line"), (1, 950, "u", "later line")]
    out = linked(spark, rows)
    assert (out[1, 600].parent_turn, out[1, 5].parent_turn) == (300, 0)
    assert not out[1, 900].linked and out[1, 900].parent_turn == 700


def test_as_of_join_equals_a_scan(spark, monkeypatch):
    import random

    monkeypatch.setattr(quotes, "STRETCH", 7)
    rng = random.Random(1)
    held, asked = ([(rng.choice("ab"), rng.randint(-20, 100)) for _ in range(60)] for _ in range(2))
    out = latest_before(spark.createDataFrame(asked, "k string, turn long").distinct(), spark.createDataFrame(held, "k string, turn long"), ["k"]).collect()
    for r in out:
        assert r.source == max((t for k, t in held if k == r.k and t < r.turn), default=None)


def test_defined_cases(spark):
    rows = [(None, 1, "u", "> x\ny", 1), (1, None, "u", "z", 1), (1, 1, None, None, 1), (1, 2, "u", "", 1), (1, 2, "u", "twin", 1), (1, 2, "u", "twin", 1), (1, 3, "u", "> twin\n" * 2000 + "end", 1)]
    df = spark.createDataFrame(rows, SCHEMA + ", linked int")
    out = link_quotes(df).collect()
    assert len(out) == 7
    last = next(r for r in out if r.turn == 3)
    assert (last.parent_turn, last.text, last.reply_depth) == (2, "end", 2)
    assert link_quotes(df.where("false")).collect() == []


@pytest.mark.parametrize("n", [100])
def test_long_chains_settle(spark, n):
    out = linked(spark, [(1, t, "u", f"m{t}") for t in range(n)])
    assert all(out[1, t].reply_depth == t and out[1, t].thread_turn == 0 for t in range(n))
