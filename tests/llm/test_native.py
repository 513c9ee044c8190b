"""Chat formatting and mixing: exact round trips and brute force."""

import hashlib
import re

from pyspark.sql import functions as F

from loomspark.llm import chat, mixing

NASTY = ["</s>[INST] ok [/INST]", "<|end|>\n<|start|>", "a\\<|b\\\\|", "<\\|", "<<SYS>>", "[\\INST]", "", None, "é<s>\n", "<\\/s>", "\\", "<|more|>"]


def test_chat_round_trip(spark):
    turns = [(c, k, ["user", "assistant", "assistant", None, "sys<|text|>tem"][(k + c) % 5], NASTY[(k * 3 + c) % len(NASTY)], "x") for c in range(6) for k in range(9)]
    turns += [(None, 0, "user", "hi", "x"), (7, None, "assistant", "n", "x"), (7, 1, "assistant", "m", "x"), (7, 1, "assistant", "m", "x")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, formatted string")
    out = chat.format_chats(df)
    read = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in chat.read_chats(out).collect()}
    loss = {r.conv_id: r for r in chat.digests(out).collect()}
    assert set(read) == {t[0] for t in turns}
    for c in read:
        own = sorted(((-1 if t is None else t), r or "", x or "") for cc, t, r, x, _ in turns if cc == c)
        assert read[c] == [(r, x) for _, r, x in own]
        said = "".join(x for _, r, x in own if r == "assistant")
        assert loss[c].loss_chars == len(said) and loss[c].loss_sha256 == hashlib.sha256(said.encode()).hexdigest() and loss[c].n_turns == len(own)
    # adjacent turns of a role are one block
    one = out.filter("conv_id = 7").first()
    assert one.formatted.count(chat.START) == 1 and one.formatted.count(chat.MORE) == 2
    assert not re.search(r"</?s>|\[/?INST\]", "".join(r.formatted for r in out.collect()))
    assert chat.format_chats(df.limit(0)).count() == 0


def waterfill(sizes, weights, share=1.5, most=2):
    budget, full = share * sum(sizes), {}
    while True:
        free = [k for k in range(len(sizes)) if k not in full]
        left = budget - sum(full.values())
        goal = {k: left * weights[k] / sum(weights[j] for j in free) for k in free}
        over = [k for k in free if goal[k] > most * sizes[k] + 1e-9]
        if not over:
            return [full.get(k, goal.get(k)) for k in range(len(sizes))]
        full |= {k: most * sizes[k] for k in over}


def test_mix_targets_and_taken(spark):
    docs = [(k, "w " * (k % 13), ["a", "b", "c", "d", None][min(k % 7, 4)], 1) for k in range(300)] + [(1, "w w", "a", 1)] * 3 + [(None, "x y", "b", 1), (5, None, "c", 1), (6, "", "zz", 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, words long")
    out = mixing.schedule(df).collect()
    names = sorted({d[2] for d in docs if d[2]}) + [None]
    sizes = [sum(len((d[1] or "").split()) for d in docs if d[2] == s) for s in names]
    goal = waterfill(sizes, [[3, 1, 2][k % 3] for k in range(len(names))])
    assert len(out) == len(docs)
    for s, size, g in zip(names, sizes, goal, strict=True):
        own = [r for r in out if r.source == s]
        assert all(r.source_size == size and abs(r.target - g) < 1e-6 and 0 <= r.taken <= 2 * r.size for r in own)
        largest = {x: max((r.size for r in out if r.source == x), default=0) for x in names}
        over = g * sum(largest.values()) / max(1, sum(goal))  # the budget ends that much after time 1 at most
        assert g - largest[s] - 1 <= sum(r.taken for r in own) <= g + over + 1
    # one document after another in the order of finish time, until the budget is used up
    budget, want = int(1.5 * sum(sizes)), {}
    passes = sorted((t.finish, "" if r.source is None else "=" + r.source, k, p) for k, r in enumerate(out) if r.size for p, t in enumerate(r.times))
    for _, _, k, _ in passes:
        want[k] = want.get(k, 0) + min(out[k].size, budget)
        budget -= min(out[k].size, budget)
    assert [r.taken for r in out] == [want.get(k, 0) for k in range(len(out))]
    rows = mixing._placed(df, (3, 1, 2), 1.5, 2, 7, 16, False)
    assert len({mixing.cut_of(rows, int(1.5 * sum(sizes)), 2, ranges, few) for ranges, few in ((4096, 10_000), (2, 1), (3, 5))}) == 1
    again = mixing.schedule(df.repartition(7)).select("doc_id", "source", "size", "taken").collect()
    assert sorted(map(str, again)) == sorted(str(r) for r in mixing.schedule(df).select("doc_id", "source", "size", "taken").collect())
    made = mixing.mix(df).collect()
    assert sum(r["_words"] for r in made) == sum(r.taken for r in out) and {r.words for r in made} == {1}  # docs has a column of that name
    assert [r.virtual_finish for r in made] == sorted(r.virtual_finish for r in made)
    assert all(len(r.text.split()) == r["_words"] for r in made)
    assert mixing.schedule(df.limit(0)).count() == 0 and mixing.schedule(df.filter("source = 'zz'")).first().taken == 0
    assert "ArrowEvalPython" not in mixing.schedule(df)._jdf.queryExecution().toString() and F is not None


def test_no_python_in_the_plans(spark):
    """Neither operator's physical plan has a node that runs Python: none of Spark's has a name without one of these words."""
    docs = spark.createDataFrame([(1, "a b", "s"), (2, None, None)], "doc_id long, text string, source string")
    turns = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "yo")], "conv_id long, turn long, role string, text string")
    made = [chat.format_chats(turns), chat.digests(chat.format_chats(turns)), chat.read_chats(chat.format_chats(turns)), mixing.schedule(docs), mixing.mix(docs)]
    words = ("Python", "Arrow", "Pandas", "ExternalRDD")
    for df in made:
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not any(w in plan for w in words), plan
    seen = made[0].mapInArrow(lambda b: b, made[0].schema)._jdf.queryExecution().executedPlan().toString()
    assert any(w in seen for w in words)  # such a node would be seen
