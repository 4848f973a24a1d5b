"""Chat formatting: exact round trips of ids and of the decoded text, and digests by hand."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from histlake.llm.chat import Codec, Template, digest_conversations, format_conversations, mask_of, read_turns
from histlake.llm.packing import tokenizer_path

PATH = tokenizer_path("byte_bpe_50k.json")
PLAIN = Template()
#: Texts made of control strings and what could be mistaken for them.
PIECES = st.lists(st.sampled_from([*PLAIN.controls, "<", "[", "\\", "/", "s>", "INST]", "SYS>>", " ok ", "é", "\U0001f600", "\n", "<\\s>", "<|endoftext|>"]), max_size=8).map("".join)


@settings(max_examples=400, deadline=None)
@given(PIECES)
def test_escaping_is_undone_and_leaves_no_control_string(text):
    escaped = PLAIN.escape(text)
    assert PLAIN.unescape(escaped) == text
    assert not any(c in escaped for c in PLAIN.controls)


@pytest.fixture(scope="module")
def codec():
    return Codec(PATH, PLAIN)


def parsed(text):
    """Role and text of each turn of a formatted text, by looking for control strings alone."""
    assert text.startswith("<s>")
    rest, out = text[3:], []

    def upto(mark):
        nonlocal rest
        at = min((rest.find(c) for c in PLAIN.controls if c in rest), default=-1)
        assert at >= 0 and rest.startswith(mark, at)
        found, rest = rest[:at], rest[at + len(mark) :]
        return PLAIN.unescape(found)

    while rest:
        for start, role, end in (("<<SYS>>", "system", "<</SYS>>"), ("[INST]", "user", "[/INST]"), ("[ROLE]", None, "[/TURN]"), ("", "assistant", "</s>")):
            if rest.startswith(start):
                rest = rest[len(start) :]
                role = upto("[/ROLE]") if role is None else role
                out.append((role, upto(end)))
                break
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant", "system", "tool", "", "User"]), PIECES), PIECES), max_size=6))
def test_ids_and_text_give_back_the_turns(codec, turns):
    known = [(r, t) for r, t in turns]
    made = list(codec.encode_turns([r for r, _ in known], [t for _, t in known]))
    ids = np.concatenate([np.array([codec.id["<s>"]], "<u4"), *[x for x, *_ in made]])
    assert list(codec.decode_turns(ids)) == known
    assert parsed(codec.text(ids)) == known
    for (ids, a, b), (_, text) in zip(made, known, strict=True):
        assert PLAIN.unescape(codec.text(ids[a:b])) == text
        assert (ids[a:b] < codec.first).all()


def test_broken_records_are_refused(codec):
    ids, *_ = next(codec.encode_turns(["user"], ["hello"]))
    for broken in (ids[:-1], ids[::-1], np.append(ids[:-1], codec.id["</s>"]), np.append(ids, np.array([5], "<u4"))):
        with pytest.raises(ValueError, match="formatted"):
            list(codec.decode_turns(broken))


def test_templates_that_cannot_be_read_back_are_refused():
    for wrong in ({"begin": "</s>"}, {"begin": "x"}, {"begin": "a\\b"}, {"begin": ">>"}, {"roles": (("user", "[U]", ""),)}, {"roles": (("user", "[U]", "[/U]"), ("tool", "[U]", "[/T]"))}):
        with pytest.raises(ValueError, match="control strings"):
            Template(**wrong)
    with pytest.raises(ValueError, match="byte-level"):
        Codec(tokenizer_path("word_bpe_49k.json"), PLAIN)


def test_mask_is_a_prefix_sum():
    assert mask_of(6, [1, 4], [3, 5]).tolist() == [0, 1, 1, 0, 1, 0]
    assert mask_of(3, [1, 1], [1, 3]).tolist() == [0, 1, 1]
    assert mask_of(0, [], []).tolist() == []


def rows_of():
    rng = random.Random(8)
    words = ["one", "<s>", "[/INST]", "\\", "[\\INST]", "é", "\n", "<<SYS>>"]
    say = lambda: " ".join(rng.choices(words, k=rng.randint(0, 12)))
    rows = [(c, t, rng.choice(["user", "assistant", "system", "tool", None]), rng.choice([say(), None, ""])) for c in range(30) for t in rng.sample(range(9), rng.randint(1, 6))]
    rows += [(40, 3, "user", "tie"), (40, 3, "assistant", "tie b"), (40, 3, "assistant", "tie a"), (40, None, "user", "last"), (40, 1, "user", "first")]
    rows += [(41, 0, "user", "again")] * 3 + [(None, 1, "user", "nobody's"), (None, 0, "assistant", "first of nobody")]
    rows += [(42, t, "user" if t % 2 else "assistant", f"turn {t} " * 20) for t in range(500)]
    return rows + [(43, 0, "assistant", "[INST]" * 20_000), (44, 0, "assistant", "a<"), (44, 1, "assistant", "\\s>"), (45, 0, None, None)]


def ordered(rows):
    by = defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((t is None, t or 0, r or "", hashlib.md5((x or "").encode()).hexdigest(), x or ""))
    return {c: [(r, x) for *_, r, _, x in sorted(turns)] for c, turns in by.items()}


@pytest.mark.parametrize("record_tokens", [1 << 20, 300])
def test_conversations_as_by_hand(spark, codec, record_tokens):
    rows = rows_of()
    turns = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, IDS string, tie int").repartition(5)
    made = format_conversations(turns, PATH, record_tokens=record_tokens).cache()
    want = ordered(rows)
    back = defaultdict(list)
    for r in sorted(read_turns(made, PATH).collect(), key=lambda r: r["place"]):
        back[r["conv_id"]].append((r["role"], r["text"]))
    assert back == want
    whole = defaultdict(lambda: [np.zeros(0, "<u4"), b""])
    for r in sorted(made.collect(), key=lambda r: r["record"]):
        ids, mask = whole[r["conv_id"]]
        assert r["start"] == len(ids) and r["n_tokens"] == len(r["ids"]) // 4 == len(r["mask"])
        assert r["n_tokens"] <= record_tokens or r["n_turns"] == 1
        whole[r["conv_id"]] = [np.append(ids, np.frombuffer(r["ids"], "<u4")), mask + r["mask"]]
    assert (made.where("record > 0").count() > 0) == (record_tokens == 300)
    digests = {r["conv_id"]: r for r in digest_conversations(made, PATH).collect()}
    assert set(digests) == set(want)
    for c, said in want.items():
        text = codec.text(whole[c][0])
        assert parsed(text) == said
        learned = [x for r, x in said if r == "assistant"]
        got = digests[c]
        assert (got["n_turns"], got["loss_chars"], got["formatted_chars"]) == (len(said), sum(map(len, learned)), len(text))
        assert got["loss_sha256"] == hashlib.sha256("".join(learned).encode()).hexdigest()
        assert got["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in said).encode()).hexdigest()
        mask = np.frombuffer(whole[c][1], np.uint8)
        runs = np.flatnonzero(np.diff(mask.astype(int), prepend=0, append=0)).reshape(-1, 2).tolist()
        assert "".join(PLAIN.unescape(codec.text(whole[c][0][a:b])) for a, b in runs) == "".join(learned)
    made.unpersist()


def test_a_template_of_ones_own(spark):
    own = Template(begin="{{start}}", roles=(("user", "{{user}}", "{{end}}"), ("bot", "{{bot}}", "{{done}}")), other=("{{role}}", "{{says}}", "{{over}}"), learned=("bot", "tool"))
    rows = [(1, 0, "user", "{{user}}"), (1, 1, "bot", "x{{end}}"), (1, 2, "tool", "{{\\bot}}"), (1, 3, "assistant", "not learned")]
    made = format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), PATH, template=own)
    assert [(r["role"], r["text"]) for r in read_turns(made, PATH, template=own).orderBy("place").collect()] == [(r, x) for *_, r, x in rows]
    got = digest_conversations(made, PATH, template=own).first()
    assert got["loss_sha256"] == hashlib.sha256(b"x{{end}}{{\\bot}}").hexdigest()


def test_no_turns(spark):
    made = format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string"), PATH)
    assert made.count() == 0 and read_turns(made, PATH).count() == 0 and digest_conversations(made, PATH).count() == 0
