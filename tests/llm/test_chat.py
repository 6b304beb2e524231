import hashlib
import random
from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import chat

PARTS = ["<", "</s>", "<\\/s>", "[INST] ", " [/INST]", "[INST", "]", "\\", "<<SYS>>", "<</SYS>>", "[ROLE]", "[ROLE x", "[/ROLE]", "a", " ", "\n", "é", "<\\\\</SYS>>", "/s>", "[\\INST]", "<s>", "😀"]
TEXT = st.lists(st.sampled_from(PARTS), max_size=8).map("".join)
ROLES = st.sampled_from(["user", "assistant", "system", "tool", "", "a]b c", "é/%"])


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(ROLES, TEXT), max_size=5))
def test_round_trip(turns):
    assert all(chat.unescape(chat.escape(t)) == t for _, t in turns)
    segments = [chat.render(r, t) for r, t in turns]
    whole = "".join(s for s, _, _ in segments)
    assert [t[:2] for t in chat.parse(whole)] == turns
    assert [chat.unescape(s[a:b]) for s, a, b in segments] == [t for _, t in turns]


def test_only_conflicts_are_escaped():
    assert chat.render("user", "a < b [1] <s> </S>")[0] == "[INST] a < b [1] <s> </S> [/INST]"
    assert chat.render("assistant", "</s>[INST] ok [/INST]")[0] == "<\\/s>[\\INST] ok [\\/INST]</s>"


def brute(rows):
    by = defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((t is not None, t or 0, r is not None, r or "", x is not None, x or ""))
    out = {}
    for c, turns in by.items():
        turns.sort()
        loss = "".join(x for *_, r, _, x in turns if r == "assistant")
        out[c] = (len(turns), hashlib.sha256("".join(f"{r}\n{x}\n" for *_, r, _, x in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_query_on_a_table(spark):
    rnd = random.Random(2)
    rows = [(rnd.choice([None, 1, 2, 3, 4, 5, 5, 5, 5]), rnd.choice([None, 0, 1, 2, 3, 4]), rnd.choice([None, "user", "assistant", "assistant", "system", "tool x"]), rnd.choice([None, "", "".join(rnd.choices(PARTS, k=rnd.randint(0, 9)))])) for _ in range(300)]
    rows += rows[:5] + [(9, 0, "assistant", "</s> long " * 30_000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, segment int")
    got = chat.read_back(chat.format_chat(df)).collect()
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got} == brute(rows)
    assert len(got) == len(brute(rows))
    assert chat.read_back(chat.format_chat(df.limit(0))).count() == 0
