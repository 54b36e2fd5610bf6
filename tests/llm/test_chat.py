import hashlib

from hypothesis import given
from hypothesis import strategies as st

from prose.llm import chat
from prose.llm.queries import tokenizer_path

SCHEMA = "conv_id long, turn long, role string, text string, path string, level int, ids string"


def rows(*turns):
    return [(*t, "x", 1, "y") for t in turns]


@given(st.text(alphabet="\\lbn<[|>a\n", max_size=30))
def test_escape_is_undone_and_hides_marks(text):
    assert chat.unescape(chat.escape(text)) == text
    assert not set("<[") & set(chat.escape(text))
    assert chat.unescape(chat.escape_role(text)) == text and "\n" not in chat.escape_role(text)


def test_tree_shares_turns_and_reads_back(spark):
    data = rows(
        (1, 0, "user", "hi <|end|>"), (1, 1, "assistant", "\\l [INST] é"), (1, 2, "user", None),
        (2, 0, "user", "hi <|end|>"), (2, 1, "assistant", "other"),
        (3, 0, "user", "hi <|end|>"), (3, 1, "assistant", "\\l [INST] é"), (3, 2, "user", None),
        (4, 0, None, "<|endoftext|>"), (None, 0, "assistant", ""), (5, 0, "a\nb", "x"), (5, 0, "a\nb", "x"),
    )
    df = spark.createDataFrame(data, SCHEMA)
    nodes, last = chat.format_tree(df, tokenizer_path("byte_bpe_50k.json"))
    nodes = nodes.cache()
    found = {r.conv_id: r for r in chat.read_back(nodes, last, tokenizer_path("byte_bpe_50k.json")).collect()}
    for conv in (1, 2, 3, 4, None, 5):
        turns = sorted(((r[1], r[2] or "", r[3] or "") for r in data if r[0] == conv))
        said = "".join(f"{r}\n{t}\n" for _, r, t in turns)
        loss = "".join(t for _, r, t in turns if r == "assistant")
        got = found[conv]
        assert got.n_turns == len(turns) and got.loss_chars == len(loss)
        assert got.turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert got.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    # Shared turns are emitted once: 3 of conversation 1 and 3, 1 more of 2, 1 of 4, 1 of null, 2 of 5.
    stream = sorted(nodes.collect(), key=lambda r: r.start)
    assert len(stream) == 8
    end = 0
    for r in stream:
        assert r.start == end and r.length == len(r.ids)
        end += r.length
        seen = [x for a in r.ancestors for x in range(a.start, a.stop)]
        assert len(seen) == r.position and all(x < r.start for x in seen)
    by_place = {x: r for r in stream for x in range(r.start, r.start + r.length)}
    for r in stream:  # depth-first: all of a node's ancestors form its path
        path = {by_place[a.start + k].level for a in r.ancestors for k in range(a.stop - a.start)}
        assert path == set(range(r.level))


def test_empty_table(spark):
    nodes, last = chat.format_tree(spark.createDataFrame([], SCHEMA), tokenizer_path("byte_bpe_50k.json"))
    assert nodes.count() == 0 and chat.read_back(nodes, last, tokenizer_path("byte_bpe_50k.json")).count() == 0


def test_a_conversation_of_many_turns_costs_what_its_turns_do(spark):
    """20 000 turns, and branches from all along it: no table holds more than a few rows or places for each turn."""
    from pyspark.sql import functions as F

    long = spark.range(20_000).selectExpr("1L AS conv_id", "id AS turn", "if(id % 2 = 0, 'user', 'assistant') AS role", "concat('t', id) AS text")
    # Conversation 100 + k says the same up to turn 150 k, and then something else, twice.
    same = spark.range(30).selectExpr("100 + id AS conv_id", "explode(sequence(0, 150 * id)) AS turn").selectExpr("conv_id", "turn", "if(turn % 2 = 0, 'user', 'assistant') AS role", "concat('t', turn) AS text")
    other = spark.range(60).selectExpr("100 + id % 30 AS conv_id", "150 * (id % 30) + 1 + id div 30 AS turn", "'user' AS role", "concat('other ', id) AS text")
    nodes, last = chat.format_tree(long.unionByName(same).unionByName(other), tokenizer_path("byte_bpe_50k.json"))
    assert nodes.count() == 20_000 + 60
    assert nodes.agg(F.max(F.size("pieces"))).first()[0] <= 25 and nodes.agg(F.max(F.size("ancestors"))).first()[0] <= 25
    end = 0
    for r in nodes.select("start", "length").orderBy("start").collect():
        assert r.start == end
        end += r.length
    got = {r.conv_id: r for r in chat.read_back(nodes, last, tokenizer_path("byte_bpe_50k.json")).collect()}
    assert len(got) == 31 and got[1].n_turns == 20_000 and {got[100 + k].n_turns for k in range(30)} == {150 * k + 3 for k in range(30)}
    said = "".join(f"{'assistant' if i % 2 else 'user'}\nt{i}\n" for i in range(20_000))
    assert got[1].turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
    fifth = "".join(f"{'assistant' if i % 2 else 'user'}\nt{i}\n" for i in range(751)) + "user\nother 5\nuser\nother 35\n"
    assert got[105].turns_sha256 == hashlib.sha256(fifth.encode()).hexdigest()
