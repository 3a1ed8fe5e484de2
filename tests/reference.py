"""Brute-force numpy versions, written position by position, for small fixtures."""

import numpy as np


def matrices(model, layer):
    return {t: getattr(model.matrix(t, layer), "values", model.matrix(t, layer))
            for t in ("norm", "q", "k", "v", "o", "ffn_norm", "gate", "up", "down")}


def rms(x, gain, eps=1e-5):
    return x / np.sqrt(np.mean(x * x) + eps) * gain


def rotate(vec, pos, head_dim, theta=100000.0):
    out, half = vec.copy(), head_dim // 2
    for h in range(0, len(vec), head_dim):
        for d in range(half):
            a = pos * theta ** (-d / half)
            lo, hi = vec[h + d], vec[h + d + half]
            out[h + d] = lo * np.cos(a) - hi * np.sin(a)
            out[h + d + half] = lo * np.sin(a) + hi * np.cos(a)
    return out


def softmax(scores, clamp=50.0):
    e = np.exp(np.clip(scores - np.max(scores), -clamp, clamp))
    return e / e.sum()


def logits(model, tokens):
    """Logits of the last position of one token list, one token at a time with a cache."""
    cfg = model.config
    emb = np.array([r.w for r in model.rows("emb").orderBy("row").collect()])
    out, out_norm = model.matrix("out").values, model.matrix("out_norm")
    cache = [[] for _ in range(cfg.n_layers)]
    for pos, token in enumerate(tokens):
        x = emb[token].copy()
        for layer in range(cfg.n_layers):
            w = matrices(model, layer)
            n = rms(x, w["norm"])
            o = np.zeros(cfg.q_dim)
            q = rotate(w["q"] @ n, pos, cfg.head_dim)
            cache[layer].append((rotate(w["k"] @ n, pos, cfg.head_dim), w["v"] @ n))
            for h in range(cfg.n_heads):
                own = slice(h * cfg.head_dim, (h + 1) * cfg.head_dim)
                g = h // cfg.gqa_group
                kv = slice(g * cfg.head_dim, (g + 1) * cfg.head_dim)
                p = softmax(np.array([q[own] @ k[kv] * cfg.score_scale for k, _ in cache[layer]]))
                o[own] = sum(pi * v[kv] for pi, (_, v) in zip(p, cache[layer]))
            x = x + o @ w["o"]
            n = rms(x, w["ffn_norm"])
            g = w["gate"] @ n
            x = x + (g / (1 + np.exp(np.clip(-g, -50, 50))) * (w["up"] @ n)) @ w["down"]
    return out @ rms(x, out_norm)


def penalise(values, recent, pen=1.2, protected=16):
    values = values.copy()
    for t in set(recent):
        if t > protected:
            values[t] = values[t] * pen if values[t] <= 0 else values[t] / pen
    return values


def greedy(model, tokens, steps, pen=1.2, window=64, stop=(0, 2)):
    tokens = list(tokens)
    for _ in range(steps):
        if tokens[-1] in stop:
            break
        scores = penalise(logits(model, tokens), tokens[-(window + 1):], pen)
        tokens.append(int(np.argmax(scores)))
    return tokens
