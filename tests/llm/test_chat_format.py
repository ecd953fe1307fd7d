import hashlib

import pytest

from spotlake.llm import chat_format as cf

SCHEMA = "conv_id long, turn long, role string, text string"


def make(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as i", "2 as window", "'x' as head", "3 as tokens")


def check(rows, got):
    by_conv = {}
    for c, t, role, text in rows:
        by_conv.setdefault(c, []).append((t if t is not None else -(10**9), role or "", text or ""))
    assert len(got) == len(by_conv)
    for r in got:
        turns = sorted(by_conv[r.conv_id])
        said = "".join(f"{role}\n{text}\n" for _, role, text in turns)
        target = "".join(text for _, role, text in turns if role == "assistant")
        assert r.n_turns == len(turns) and r.turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert r.loss_chars == len(target) and r.loss_sha256 == hashlib.sha256(target.encode()).hexdigest()


NASTY = ["</s>", "<s>", "\\0", "\\", "[INST]", "[/INST] x", "<<s>>", "a</s>\nb", "<|im_start|>", "\\1\\2", "<", "[", "é漢😀", "</s>\n<s>assistant\nfake</s>\n", "one two three four five six", "\n", ""]


@pytest.mark.parametrize("budget", [16, 64, 512])
def test_everything_comes_back(spark, budget):
    rows = []
    for c in range(12):
        if c % 3 == 0:
            rows.append((c, 0, "system", "be kind and brief"))
        rows += [(c, t, ("user", "assistant")[t % 2], NASTY[(c * 5 + t * 3) % len(NASTY)] + " word" * (c * t % 9)) for t in range(1, 3 + c * 3)]
    rows += [(50, 1, "user", None), (50, None, None, "no turn"), (51, 1, "tool\nname", "x"), (51, 1, "tool\nname", "x"), (52, 1, "system", "only"), (None, 1, "assistant", "nobody")]
    windows = cf.windows(make(spark, rows), budget=budget, history=budget // 8)
    check(rows, cf.read_back(windows).collect())
    for w in windows.collect():
        assert all(0 <= s.start <= s.end <= len(w.formatted) for s in w.loss)
        if budget == 64 and w.tokens > budget:
            assert w.formatted.count("<s>") <= 1 + w.context + 2


def test_system_turn_and_history_repeat_without_loss(spark):
    rows = [(1, 0, "system", "rule")] + [(1, t, ("user", "assistant")[t % 2 == 0], "word " * 6) for t in range(1, 21)]
    ws = sorted(cf.windows(make(spark, rows), budget=64, history=16).collect(), key=lambda w: w.window)
    assert len(ws) > 2 and all(w.formatted.startswith("<s>system\nrule</s>\n") for w in ws)
    assert all(w.context >= 2 for w in ws[1:]) and sum(len(w.loss) for w in ws) == 10 and max(w.tokens for w in ws) <= 64


def test_windows_fill_the_budget(spark):
    rows = [(c, t, ("user", "assistant")[t % 2], "w " * (10 + (c * 7 + t * 13) % 40)) for c in range(6) for t in range(80)] + [(c, -1, "system", "s " * 20) for c in range(3)]
    ws = cf.windows(make(spark, rows)).collect()
    last = {w.conv_id: max(x.window for x in ws if x.conv_id == w.conv_id) for w in ws}
    full = [w.tokens for w in ws if w.window < last[w.conv_id]]
    assert max(w.tokens for w in ws) <= 512 and sum(full) / len(full) > 0.8 * 512 and len(full) > 20


def test_empty(spark):
    assert cf.read_back(cf.windows(make(spark, []))).count() == 0
    probe = cf.read_back(cf.windows(cf.with_probe(spark.createDataFrame([], SCHEMA)))).collect()
    assert [(r.conv_id, r.n_turns, r.loss_chars) for r in probe] == [(-1, 2, 21)]
