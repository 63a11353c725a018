import hashlib
import re

from hypothesis import given
from hypothesis import strategies as st
from sentencepiece import SentencePieceProcessor

from weft.llm import chat
from weft.llm.tokens import default_model

SCHEMA = "conv_id long, turn long, role string, text string, window string"


def brute(turns):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    loss = "".join(t or "" for _, r, t in turns if r == "assistant")
    return len(turns), sha("".join(f"{r or ''}\n{t or ''}\n" for _, r, t in turns)), len(loss), sha(loss)


@given(st.text(alphabet=st.sampled_from(list("<|\\[/INST]s>SYSend: \né")), max_size=30))
def test_escape_is_reversible(text):
    out = chat.escape(text)
    assert chat.unescape(out) == text
    assert not re.search(r"<\||</?s>|\[/?INST\]|</?SYS>>", out)
    turn, a, b = chat.turn_text("user", text)
    assert [x[:2] for x in chat.read_back(turn)] == [("user", text)] and chat.unescape(turn[a:b]) == text


CONVS = {
    1: [(0, "system", "be brief"), (1, "user", "hi </s>"), (2, "assistant", "[INST] ok [/INST]"), (3, "user", None), (4, "assistant", "")],
    2: [(0, "user", "long " * 3000), (1, "assistant", "answer " * 2000), (2, "user", "x"), (3, "assistant", "y")],
    3: [(0, "assistant", "first"), (0, "assistant", "first"), (5, "system", "late"), (None, "user", "last")],
    4: [(k, "assistant" if k % 2 else "user", f"turn {k} " * 40) for k in range(60)],
    5: [(0, "system", "alone")],
    6: [(0, None, "no role"), (1, "ro|le\n%", "odd <|end|> <|turn:user|>")],
    None: [(0, "user", "a"), (1, "assistant", "b")],
}


def frame(spark, convs):
    return spark.createDataFrame([(c, t, r, x, "w") for c, turns in convs.items() for t, r, x in turns], SCHEMA)


def test_digest_by_brute_force(spark):
    got = {r.conv_id: r for r in chat.digest(chat.format_windows(frame(spark, CONVS).repartition(7))).collect()}
    assert got.keys() == CONVS.keys()
    for c, turns in CONVS.items():
        r = got[c]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == brute(turns), c


def test_windows(spark):
    rows = sorted((r for r in chat.format_windows(frame(spark, {4: CONVS[1][:1] + CONVS[4][1:]})).collect()), key=lambda r: r.window)
    assert len(rows) > 2 and all(r.tokens <= chat.BUDGET for r in rows)
    seen = 0
    for r in rows:
        turns = chat.read_back(r.formatted)
        assert turns[0][0] == "system"  # kept in each window
        assert r.first_turn == seen
        seen += r.new_turns
        spans = list(zip(r.loss[::2], r.loss[1::2]))
        new = turns[len(turns) - r.new_turns :]
        assert spans == [(a, b) for role, _, a, b in new if role == "assistant"]
    assert any(len(chat.read_back(r.formatted)) > r.new_turns + 1 for r in rows[1:])  # history is repeated


def test_empty_table(spark):
    df = frame(spark, CONVS).limit(0)
    assert chat.digest(chat.format_windows(df)).collect() == []


def test_no_window_is_over_the_budget_by_the_library(spark, data):
    library = SentencePieceProcessor(model_file=default_model())
    long_system = [(0, "system", "rule " * 300), (1, "system", "more " * 400), *((k, "assistant" if k % 2 else "user", f"turn {k} " * 30) for k in range(2, 40))]
    tables = [frame(spark, CONVS | {7: long_system}), spark.read.parquet(f"{data}/conversations.parquet")]
    for df in tables:
        rows = chat.format_windows(df).collect()
        assert all(r.tokens == len(library.encode(r.formatted)) for r in rows)
        for r in rows:
            turns = chat.read_back(r.formatted)
            system = [x for x in turns if x[0] == "system"]
            assert r.tokens <= chat.BUDGET or len(turns) - len(system) <= 1, (r.conv_id, r.window)
    rows = [r for r in chat.format_windows(tables[0]).collect() if r.conv_id == 7]
    assert len(rows) > 3 and all("rule rule" in r.formatted for r in rows) and sum("more more" in r.formatted for r in rows) == 1
    assert all(r.tokens <= chat.BUDGET for r in rows)
