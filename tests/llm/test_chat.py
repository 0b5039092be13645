import hashlib
import random
import re

import pytest
from fixtures import plain

from effortlens.llm import chat
from effortlens.llm.queries import QUERIES

SCHEMA = "conv_id long, turn long, role string, text string"
TOKEN = re.compile(r"[^\W\d_]+|\d|[^\s\w]|_|\s+")


def conversations(seed=3):
    rng = random.Random(seed)
    words = "a bb ccc </s>[INST] ok [/INST] <s> \\ \\\\ <\\s> [\\INST] < [ \n 7 é 日本 😀".split(" ")
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = []
    for conv in range(40):
        turns = rng.choice([1, 2, 3, 8, 30, 90])
        numbers = sorted(rng.sample(range(-20, 200), turns))
        for i, n in enumerate(numbers):
            role = "system" if i == 0 and conv % 3 == 0 else ("user", "assistant")[(i + conv) % 2]
            rows.append((conv, n, role, say(rng.choice([0, 1, 5, 20, 60]))))
    rows += [(50, None, "user", "no number"), (50, 0, "assistant", None), (51, 1, None, "no role"), (51, 1, None, "no role"), (51, 2, "assistant", "")]
    rows += [(None, i, ("user", "assistant")[i % 2], f"none {i}") for i in range(20)]
    rows += [(52, 0, "system", "alone"), (53, 0, "system", "s " * 300), (53, 1, "assistant", "x " * 5000), (53, 2, "user", "after")]
    rows += [(54, 5, "assistant", "tie b"), (54, 5, "assistant", "tie a"), (54, 6, "odd </s> [/INST] role\n", "x [/INST] y</s>"), (54, 7, "system", "late")]
    rows += [(55, -(1 << 63), "user", "least"), (55, (1 << 63) - 1, "assistant", "most")]
    rng.shuffle(rows)
    return rows


def by_conversation(rows):
    out = {}
    for conv, turn, role, text in rows:
        out.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [(t, r, x) for _, t, r, x in sorted(v)] for c, v in out.items()}


def size(text):
    return len(TOKEN.findall(text)) + chat.MARK_TOKENS


def spans(turns, budget, history, history_turns, part_turns):
    """(new turns, repeated turns) of every window, by one walk along the conversation."""
    system = turns[0] if turns[0][1] == "system" else None
    rest = turns[1:] if system else turns
    room = budget - history - (size(system[2]) if system else 0)
    part = lambda t: t[0] // part_turns
    out, used = [], 0
    for i, t in enumerate(rest):
        if not out or used + size(t[2]) > room or part(t) != part(rest[i - 1]):
            back = i
            near = lambda j: part(rest[j]) == part(t) or rest[j][0] >= part(t) * part_turns - history_turns
            while back and i - back < history_turns and sum(size(x[2]) for x in rest[back - 1 : i]) <= history and near(back - 1):
                back -= 1
            out.append(([t], rest[back:i]))
            used = size(t[2])
        else:
            out[-1][0].append(t)
            used += size(t[2])
    if not out:
        return [([system], [])]
    if system:
        first = out[0]
        same = part(first[0][0]) == part(system)
        out = [(new, [system, *old]) for new, old in out]
        out[0] = ([system, *first[0]], first[1]) if same else out[0]
        if not same:
            out.insert(0, ([system], []))
    return out


def escaped(text):
    return re.sub(r"(.)(/?s>|/?INST\])", lambda m: m[0] if m[1] + m[2] not in chat.CONTROL else f"{m[1]}\\{m[2]}", text.replace("\\", "\\\\"), flags=re.S)


@pytest.mark.parametrize("limits", [(60, 20, 3, 1024), (200, 0, 0, 1024), (120, 40, 5, 16), (2048, 512, 6, 1024)])
def test_windows_by_one_walk(spark, limits):
    rows = [r for r in conversations() if r[0] != 55]
    found = chat.windows(spark.createDataFrame(rows, SCHEMA), *limits).orderBy("part", "window").collect()
    got = {}
    for r in found:
        got.setdefault(r["conv_id"], []).append(r)
    wanted = {c: spans(t, *limits) for c, t in by_conversation(rows).items() if None not in (x[1] for x in rows if x[0] == c)}
    assert got.keys() == {r[0] for r in rows}
    for conv, windows in wanted.items():
        assert len(windows) == len(got[conv]), conv
        for (new, old), r in zip(windows, got[conv]):
            pieces, loss = [], []
            for i, (_, role, text) in enumerate([*old, *new]):
                head = f"<s>[INST] {escaped(role)} [/INST] "
                at = sum(map(len, pieces)) + len(head)
                if role == "assistant" and i >= len(old):
                    loss.append((at, at + len(escaped(text))))
                pieces.append(head + escaped(text) + "</s>")
            assert r["text"] == "".join(pieces)
            assert [tuple(s) for s in r["loss"]] == loss
            total = sum(size(t[2]) for t in [*old, *new])
            assert (r["n_turns"], r["n_repeated"], r["n_tokens"], r["oversized"]) == (len(old) + len(new), len(old), total, total > limits[0])
            # Over the budget only where a turn, or the system turn, leaves no other way.
            assert not r["oversized"] or len(new) == 1 or new[0][1] == "system" and len(new) == 2


def digests(rows):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    out = []
    for conv, turns in by_conversation(rows).items():
        loss = "".join(text for _, role, text in turns if role == "assistant")
        out.append((conv, len(turns), sha("".join(f"{r}\n{t}\n" for _, r, t in turns)), len(loss), sha(loss)))
    return out


COLUMNS = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256"]


def test_read_back(spark, tmp_path):
    rows = conversations()
    frame = spark.createDataFrame(rows, SCHEMA)
    extra = frame.selectExpr("*", "'x' AS part", "'y' AS window", "'z' AS loss", "'w' AS tokens", "'k' AS kind", "'p' AS place")
    extra.write.parquet(f"{tmp_path}/conversations.parquet")
    own = (-7, 2), [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    got = QUERIES["op12_chat_windows"](spark, str(tmp_path)).collect()
    assert plain([tuple(r[c] for c in COLUMNS) for r in got]) == plain(digests(rows + own[1]))
    assert all(r["formatted_chars"] > r["loss_chars"] for r in got)


def test_no_rows(spark, tmp_path):
    assert chat.windows(spark.createDataFrame([], SCHEMA)).collect() == []
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    assert [r["conv_id"] for r in QUERIES["op12_chat_windows"](spark, str(tmp_path)).collect()] == [-7]


def test_texts_never_hold_control_strings(spark):
    texts = ["".join(random.Random(i).choices(["<", "/", "s>", "[", "INST", "]", "\\", "x", "[/INST]", "</s>"], k=12)) for i in range(300)]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = frame.select("t", chat.escape(frame.t).alias("e"), chat.unescape(chat.escape(frame.t)).alias("u")).collect()
    assert all(r["u"] == r["t"] and not any(c in r["e"] for c in chat.CONTROL) for r in rows)


def test_one_long_conversation_is_split(spark):
    frame = spark.range(5000).selectExpr("9 AS conv_id", "id AS turn", "if(id = 0, 'system', if(id % 2 = 0, 'assistant', 'user')) AS role", "concat('text ', id) AS text")
    found = chat.windows(frame, 200, 60, 4)
    rows = found.orderBy("part", "window").collect()
    assert {r["part"] for r in rows} == set(range(5)) and not any(r["oversized"] for r in rows)
    assert all(r["text"].startswith("<s>[INST] system [/INST] text 0</s>") for r in rows)
    assert all(r["n_repeated"] == 5 for r in rows[1:])
    read = chat.read_back(found).orderBy("part", "window").collect()
    assert [t["text"] for r in read for t in r["turns"]] == [f"text {i}" for i in range(5000)]
    assert [t for r in read for t in r["targets"]] == [f"text {i}" for i in range(2, 5000, 2)]


def test_whole_table(spark, sf_dir):
    rows = [tuple(r[c] for c in ("conv_id", "turn", "role", "text")) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").collect()]
    rows += [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    got = QUERIES["op12_chat_windows"](spark, sf_dir).collect()
    assert plain([tuple(r[c] for c in COLUMNS) for r in got]) == plain(digests(rows))
