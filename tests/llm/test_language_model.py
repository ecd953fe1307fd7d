import math
import zlib
from collections import Counter

import numpy as np

from spotlake.llm import language_model as lm


def test_gradients():
    g = lm.Gru(40)
    g.w = {k: v.astype(np.float64) for k, v in g.w.items()}
    rng = np.random.default_rng(0)
    grid, fresh, live = rng.integers(2, 40, (9, 5)), np.zeros((9, 5), bool), np.array([5] * 6 + [4] * 2 + [2])
    fresh[0], fresh[4, 1], fresh[7, 0], grid[3, 1], grid[6, 0] = True, True, True, lm.END, lm.END
    start = lambda: (rng.normal(size=(5, lm.HIDDEN)) * 0, np.full(5, lm.END))

    def loss():
        (h, last), total = start(), 0.0
        for t in range(9):
            h, _ = g.step(last, np.where(fresh[t][:, None], 0.0, h))
            total -= g.log_probability(h[: live[t]], grid[t, : live[t]]).sum()
            last = grid[t]
        return total / live.sum()

    grads, _ = g._window(grid, fresh, live, *start())
    for k, v in g.w.items():
        for i in np.argsort(-np.abs(grads[k]).reshape(-1))[:3].tolist():
            flat = v.reshape(-1)
            old = flat[i]
            flat[i] = old + 1e-5
            up = loss()
            flat[i] = old - 1e-5
            down = loss()
            flat[i] = old
            assert abs((up - down) / 2e-5 - grads[k].reshape(-1)[i]) < 1e-6


def test_every_token_gives_a_gradient(monkeypatch):
    texts = [np.append(np.random.default_rng(i).integers(2, 30, i * 7 % 90), lm.END) for i in range(50)]
    g, seen = lm.Gru(30), []
    old = lm.Gru._window
    monkeypatch.setattr(lm.Gru, "_window", lambda self, grid, fresh, live, *rest: (seen.extend(grid[np.arange(grid.shape[1]) < live[:, None]].tolist()), old(self, grid, fresh, live, *rest))[1])
    g.train(texts, lanes=4)
    assert sorted(seen) == sorted(np.concatenate(texts).tolist())


def test_probabilities_sum_to_one_and_state_is_carried():
    g = lm.Gru(50)
    h = np.random.default_rng(1).normal(size=(1, lm.HIDDEN)).astype(np.float32)
    assert abs(np.exp(g.log_probability(np.repeat(h, 50, axis=0), np.arange(50))).sum() - 1) < 1e-4
    text = np.append(np.random.default_rng(2).integers(2, 50, 3 * lm.WINDOW + 5), lm.END)
    h, last, total = np.zeros((1, lm.HIDDEN), np.float32), np.array([lm.END]), 0.0
    for t in text:
        h, _ = g.step(last, h)
        total += g.log_probability(h, np.array([t]))[0]
        last = np.array([t])
    alone, beside = g.score([text]), g.score([text[:7], text, text[:1]])
    assert abs(alone[0] - total) < 1e-2 and abs(beside[1] - total) < 1e-2


def test_counts_and_scores(frame, monkeypatch):
    monkeypatch.setattr(lm, "HEAD", 6)  # most words are rare and take the joined way
    monkeypatch.setattr(lm, "SYMBOLS", 4)
    rng = np.random.default_rng(0)
    rows = [(i, " ".join(f"W{int(k)}" for k in rng.zipf(1.6, rng.integers(0, 30)) if k < 60)) for i in range(80)] + [(900, None), (901, "")]
    counts, out = Counter(), {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows}
    tokens = {i: [*(t or "").lower().split(), None] for i, t in rows}
    for i, t in tokens.items():
        if not out[i]:
            counts.update(t)
    n, v = sum(counts.values()), len(counts)
    kept, average = [], lm._averaged
    monkeypatch.setattr(lm, "_averaged", lambda docs, head, model: (kept.append((head, average(docs, head, model))), kept[0][1])[1])
    got = lm.score_texts(frame(rows)).collect()
    (head, model), symbols = kept[0], {}
    for word in sorted(head.place, key=head.place.get)[:4]:
        symbols[word] = len(symbols) + 2
    assert len(symbols) >= 3 and counts[max(counts, key=lambda w: counts[w] if w else 0)] == max(counts[w.decode()] for w in symbols)
    beyond = {w: c for w, c in counts.items() if w and w.encode() not in symbols}

    def whole_score(words):
        h, last, total = np.zeros((1, lm.HIDDEN), np.float32), lm.END, 0.0
        for w in words:
            symbol = lm.END if w is None else symbols.get(w.encode(), lm.OTHER)
            h, _ = model.step(np.array([last]), h)
            total += model.log_probability(h, np.array([symbol]))[0] / math.log(10)
            if symbol == lm.OTHER:
                total += math.log10((beyond.get(w, 0) + 1) / (sum(beyond.values()) + len(beyond) + 1))
            last = symbol
        return total

    assert len(got) == len(rows)
    for r in got:
        t = tokens[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out[r.doc_id], len(t), sum(counts[x] > 0 for x in t), n)
        assert abs(r.base_score - sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in t)) < 1e-8
        assert abs(r.score - whole_score(t)) < 1e-3


def test_learns_order(frame):
    rows = [(i, " ".join(["a b c d"] * 12)) for i in range(200)] + [(1001, "a b c d " * 8), (1002, "d c b a " * 8)]
    got = {r.doc_id: r for r in lm.score_texts(frame(rows)).collect()}
    assert got[1001].score > got[1002].score and got[1001].score > got[1001].base_score


def test_averaged_pass_learns_from_whole_texts(frame, monkeypatch):
    monkeypatch.setattr(lm, "FIRST_TEXTS", 0)  # what is learned comes from the averaged pass alone
    start = "z " * 100  # longer than a piece of the former pass
    rows = [(i, start + "a b c d " * 30) for i in range(500)] + [(1001, start + "a b c d " * 30)]
    got = {r.doc_id: r for r in lm.score_texts(frame(rows).coalesce(1)).collect()}
    assert all(r.score > r.base_score + 20 for r in got.values())  # 3 before, when only the first 64 tokens were learned from


def test_commonest_words(spark):
    rows = [(f"w{i}".encode(), c) for i, c in enumerate([900, 50, 50, 7, 7, 7, 1, 1, 1, 1])]
    df = spark.createDataFrame(rows, "word binary, c long")
    for most, want in ((10, 10), (9, 6), (6, 6), (5, 3), (3, 3), (2, 1), (0, 0)):  # ties that don't fit stay out together
        words, counts = lm._commonest(df, most)
        assert words == [w for w, _ in rows[:want]] and counts == [c for _, c in rows[:want]]


def test_odd_rows(odd, none):
    got = lm.score_texts(odd).collect()
    assert len(got) == odd.count() and lm.score_texts(none).count() == 0
    assert all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in got)
