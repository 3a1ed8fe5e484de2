"""The same queries in SQL, in long relational form, for an independent engine."""

from __future__ import annotations

from relinfer.config import TINY
from relinfer.plans.catalog import DOC_VOCAB, PARAMS, SEED, SPAN, WIDE
from relinfer.sources.text import SPECIALS, SYSTEM_PROMPT, TOKEN_PATTERN, UNK_ID
from relinfer.sources.weights import GAIN_KINDS, KINDS


def element(tensor: str, layer: int, o: str, i: str) -> str:
    """A matrix element; `o` is the output and `i` the input index."""
    return (
        f"(0.25*sin(1.0::DOUBLE + {KINDS[tensor]}*0.7::DOUBLE + {layer}*1.3::DOUBLE"
        f" + {o}*0.31::DOUBLE + {i}*0.17::DOUBLE + {o}*{i}*0.013::DOUBLE))"
    )


def gain(tensor: str, layer: int, i: str) -> str:
    return f"(1.0 + 0.1*cos({GAIN_KINDS[tensor]}*0.5::DOUBLE + {layer} + {i}*0.3::DOUBLE))"


def rnd(value: str, places: int = 6) -> str:
    return f"round({value}, {places}) + 0.0"


def clamped(value: str) -> str:
    return f"exp(greatest(least({value}, 50.0), -50.0))"


def uniform(*keys: str) -> str:
    text = f"concat_ws('|', {SEED}, {', '.join(keys)})"
    return f"((CAST('0x' || substr(md5({text}), 1, 12) AS BIGINT) % 999999 + 1) / 1000000.0::DOUBLE)"


def query(ctes: list[tuple[str, str]], final: str) -> str:
    return "WITH " + ",\n".join(f"{n} AS ({b})" for n, b in ctes) + "\n" + final


X = ("x", "SELECT vec_id AS seq_id, unnest(embedding)::DOUBLE AS val,"
     " (generate_subscripts(embedding, 1) - 1)::BIGINT AS i FROM embeddings")
XS = ("xs", f"SELECT seq_id // {SPAN} AS seq_id, seq_id % {SPAN} AS pos, i, val FROM x")


def linear(tensor: str, n_out: int, source: str = "x", keys: str = "seq_id") -> str:
    return (
        f"SELECT {keys}, o AS i, sum(val * {element(tensor, 0, 'o', 'i')}) AS val"
        f" FROM {source}, range({n_out}) t(o) GROUP BY {keys}, o"
    )


LONG = f"SELECT seq_id, i, {rnd('val')} AS val FROM y"

# ------------------------------------------------------------- vector algebra

LOGITS = ("lg", linear("out", WIDE.vocab_size).replace("o AS i", "o AS token"))

ALGEBRA = {
    "dot_scores": query([X, LOGITS], f"SELECT seq_id, token, {rnd('val')} AS val FROM lg"),
    "linear_packed": query([X, ("y", linear("q", WIDE.q_dim))], LONG),
    "linear_inline": query([X, ("y", linear("k", WIDE.kv_dim))], LONG),
    "linear_transposed": query([X, ("y", linear("o", WIDE.hidden))], LONG),
    "linear_joined": query([X, ("y", linear("o", WIDE.hidden))], LONG),
    "rms_norm": query(
        [X],
        f"SELECT seq_id, i, {rnd('val / sqrt(avg(val*val) OVER (PARTITION BY seq_id) + 1e-5) * ' + gain('norm', 0, 'i'))}"
        " AS val FROM x",
    ),
    "scale_by": query(
        [X],
        f"SELECT seq_id, i, {rnd('val * (label + 1) * ' + gain('ffn_norm', 0, 'i'))} AS val"
        " FROM x JOIN embeddings ON vec_id = seq_id",
    ),
    "residual_add": query(
        [X],
        f"SELECT a.seq_id, a.i, {rnd('a.val + CASE WHEN label <> 0 THEN b.val ELSE 0 END')} AS val"
        " FROM x a JOIN x b ON a.seq_id = b.seq_id AND b.i = 63 - a.i"
        " JOIN embeddings ON vec_id = a.seq_id",
    ),
    "swiglu": query(
        [X, ("g", linear("gate", WIDE.ffn_dim)), ("u", linear("up", WIDE.ffn_dim))],
        f"SELECT seq_id, i, {rnd('g.val / (1 + ' + clamped('-g.val') + ') * u.val')} AS val"
        " FROM g JOIN u USING (seq_id, i)",
    ),
    "split_heads": query(
        [X], f"SELECT seq_id, i // 16 AS head, i % 16 AS i, {rnd('val')} AS val FROM x"
    ),
    "head_index": query(
        [X], f"SELECT seq_id, i AS o, {rnd('val')} AS val, i // 16 AS head, i % 16 AS h_dim FROM x"
    ),
    "transpose_matrix": query(
        [X], f"SELECT seq_id, i % 16 AS in_idx, i // 16 AS i, {rnd('val')} AS val FROM x"
    ),
}
SUMS = (
    "sums",
    "SELECT label::BIGINT AS label, i, sum(val / (1 + vec_id % 5)) AS val"
    " FROM x JOIN embeddings ON vec_id = seq_id GROUP BY ALL",
)
ALGEBRA["vec_weighted_sum"] = query([X, SUMS], f"SELECT label, i, {rnd('val')} AS val FROM sums")
ALGEBRA["label_affinity"] = query(
    [X, SUMS],
    f"SELECT vec_id, {rnd('sum(x.val * s.val)')} AS score, {rnd('sum(s.val * s.val)')} AS norm_sq"
    " FROM x JOIN embeddings e ON vec_id = seq_id JOIN sums s ON s.label = e.label AND s.i = x.i"
    " GROUP BY vec_id",
)

# ------------------------------------------------------------------ attention


def angle(pos: str, d: str, half: int) -> str:
    return f"({pos} * pow(100000.0::DOUBLE, -(({d}) % {half}) / {half}.0::DOUBLE))"


def rope(source: str, keys: list[str], dim: int, index: str = "i") -> str:
    """Rotate every head of `dim` components of long rows (keys, pos, index, val)."""
    half = dim // 2
    on = " AND ".join(f"a.{k} = b.{k}" for k in [*keys, "pos"])
    a = angle("a.pos", f"a.{index}", half)
    partner = f"(a.{index} // {dim}) * {dim} + (a.{index} + {half}) % {dim}"
    return (
        f"SELECT {', '.join('a.' + k for k in [*keys, 'pos', index])},"
        f" CASE WHEN a.{index} % {dim} < {half} THEN a.val * cos({a}) - b.val * sin({a})"
        f" ELSE b.val * sin({a}) + a.val * cos({a}) END AS val"
        f" FROM {source} a JOIN {source} b ON {on} AND b.{index} = {partner}"
    )


def heads(source: str, dim: int, index: str = "i") -> str:
    return (
        f"SELECT seq_id, pos, {index} // {dim} AS head, list(val ORDER BY {index}) AS vec"
        f" FROM {source} GROUP BY seq_id, pos, {index} // {dim}"
    )


def scores(q: str, k: str, group: int, dim: int) -> str:
    return (
        f"SELECT q.seq_id, q.pos, q.head, k.pos AS kpos,"
        f" list_inner_product(q.vec, k.vec) / sqrt({dim}.0::DOUBLE) AS val"
        f" FROM {q} q JOIN {k} k ON q.seq_id = k.seq_id AND k.head = q.head // {group} AND k.pos <= q.pos"
    )


def weights(source: str) -> str:
    e = clamped("val - max(val) OVER (PARTITION BY seq_id, pos, head)")
    return (
        "SELECT seq_id, pos, head, kpos, e / sum(e) OVER (PARTITION BY seq_id, pos, head) AS prob"
        f" FROM (SELECT *, {e} AS e FROM {source})"
    )


def mix(w: str, v: str, group: int, dim: int) -> str:
    """`v` is long: (seq_id, pos, i, val) with concatenated heads."""
    return (
        f"SELECT w.seq_id, w.pos, w.head * {dim} + v.i % {dim} AS i, sum(w.prob * v.val) AS val"
        f" FROM {w} w JOIN {v} v ON v.seq_id = w.seq_id AND v.pos = w.kpos"
        f" AND v.i // {dim} = w.head // {group} GROUP BY ALL"
    )


XS_K = ("xk", "SELECT * FROM xs WHERE i < 32")
XS_V = ("xv", "SELECT seq_id, pos, i - 32 AS i, val FROM xs WHERE i >= 32")
GQA = [
    X, XS, XS_K, XS_V, ("q", heads("xs", 16)), ("k", heads("xk", 16)),
    ("sc", scores("q", "k", 2, 16)), ("sm", weights("sc")),
]
LONG_POS = f"SELECT seq_id, pos, i, {rnd('val')} AS val FROM y"

ATTENTION = {
    "rope_lookup": query(
        [X, XS],
        f"SELECT DISTINCT seq_id, pos, h_dim, {rnd('cos(pos*f)')} AS cos_val, {rnd('sin(pos*f)')} AS sin_val"
        " FROM (SELECT DISTINCT seq_id, pos FROM xs),"
        " (SELECT h_dim, pow(100000.0::DOUBLE, -(h_dim // 2 * 2) / 16.0::DOUBLE) AS f FROM range(16) t(h_dim))",
    ),
    "rope_apply": query([X, XS, ("y", rope("xs", ["seq_id"], 64))], LONG_POS),
    "rope_joined": query([X, XS, ("y", rope("xs", ["seq_id"], 16))], LONG_POS),
    "attn_scores": query(GQA, f"SELECT seq_id, pos, head, kpos, {rnd('val')} AS val FROM sc"),
    "attn_weights": query(GQA, f"SELECT seq_id, pos, head, kpos, {rnd('prob')} AS prob FROM sm"),
    "gqa_attention": query([*GQA, ("y", mix("sm", "xv", 2, 16))], LONG_POS),
    "causal_attention": query(
        [X, XS, ("r", rope("xs", ["seq_id"], 64)), ("q", heads("r", 64)),
         ("sc", scores("q", "q", 1, 64)), ("sm", weights("sc")), ("o", mix("sm", "xs", 1, 64)),
         ("y", "SELECT seq_id, pos, i, val FROM o")],
        "SELECT seq_id, pos, i, round(val, 6) + 0.0 AS val FROM y",
    ),
    "kv_append": query(
        [X, XS,
         ("c", "SELECT seq_id, pos, sum(CASE WHEN i < 32 THEN val*val ELSE 0 END) AS k_sq,"
               " sum(CASE WHEN i >= 32 THEN val*val ELSE 0 END) AS v_sq FROM xs GROUP BY ALL")],
        f"SELECT seq_id, pos + step * {SPAN} AS pos, {rnd('k_sq')} AS k_sq, {rnd('v_sq')} AS v_sq"
        " FROM c, range(2) t(step)",
    ),
}

# ------------------------------------------------------------------- sampling


def softmax(source: str, keys: str, value: str) -> str:
    e = clamped(f"{value} - max({value}) OVER (PARTITION BY {keys})")
    return (
        f"SELECT * EXCLUDE (e), e / sum(e) OVER (PARTITION BY {keys}) AS prob"
        f" FROM (SELECT *, {e} AS e FROM {source})"
    )


# Sampling settings as expressions: the defaults, and those of the rows with a settings table.
DEFAULTS = {k: str(v) for k, v in vars(PARAMS).items()}
GIVEN = {
    "temp": "seq_id % 3 * 0.25 + 0.5", "top_p": "seq_id % 4 * 0.125 + 0.5", "top_k": "seq_id % 7 * 5 + 1",
    "min_p": "seq_id % 5 * 0.03125", "rep_pen": "seq_id % 4 * 0.25 + 1", "max_pos": "seq_id % 100 + 20",
}
BY_ROW = {k: f"(CASE WHEN seq_id % 2 = 0 THEN ({v})::DOUBLE ELSE {DEFAULTS[k]} END)" for k, v in GIVEN.items()}


def best(source: str, keys: str, min_p: str = DEFAULTS["min_p"]) -> str:
    return (
        f"SELECT * EXCLUDE (mx) FROM (SELECT *, max(prob) OVER (PARTITION BY {keys}) AS mx"
        f" FROM {source}) WHERE prob >= mx * {min_p}"
    )


def first_k(source: str, keys: str, k: int | str) -> str:
    return (
        f"SELECT * FROM {source} QUALIFY row_number() OVER"
        f" (PARTITION BY {keys} ORDER BY prob DESC, token) <= {k}"
    )


def nucleus(source: str, keys: str, top_p: str = DEFAULTS["top_p"]) -> str:
    return (
        f"SELECT * EXCLUDE (cdf) FROM (SELECT *, sum(prob) OVER (PARTITION BY {keys}"
        f" ORDER BY prob DESC, token ROWS UNBOUNDED PRECEDING) AS cdf FROM {source})"
        f" WHERE cdf - prob <= {top_p}"
    )


def draw(source: str, keys: list[str], value: str = "t_val") -> str:
    listed = ", ".join(keys)
    g = f"{value} - ln(-ln({uniform(*keys, 'token')}))"
    return (
        f"SELECT {listed}, token FROM {source} QUALIFY row_number() OVER"
        f" (PARTITION BY {listed} ORDER BY {g} DESC, token) = 1"
    )


def chain(source: str, keys: str = "seq_id", p: dict[str, str] = DEFAULTS) -> list[tuple[str, str]]:
    """Temperature, softmax, min-p, top-k and top-p; ends in `tp`."""
    return [
        ("tl", f"SELECT *, val / {p['temp']} AS t_val FROM {source}"),
        ("pr", softmax("tl", keys, "t_val")), ("mp", best("pr", keys, p["min_p"])),
        ("tk", first_k("mp", keys, p["top_k"])), ("tp", nucleus("tk", keys, p["top_p"])),
    ]


EV = ("ev", "SELECT user_id, event_type, event_id AS token, value, value / 50.0 AS t_val FROM events")
PROB9 = rnd("prob", 9) + " AS prob"

SAMPLING = {
    "softmax_grouped": query([EV, ("p", softmax("ev", "user_id", "value"))], f"SELECT token, user_id, {PROB9} FROM p"),
    "softmax_hot": query([EV, ("p", softmax("ev", "event_type", "value"))], f"SELECT token, event_type, {PROB9} FROM p"),
    "temperature": f"SELECT event_id AS token, {rnd('value / ' + str(PARAMS.temp))} AS t_val FROM events",
    "with_params": query(
        [("p", "SELECT user_id, count(*) % 3 * 0.25::DOUBLE + 0.5 AS temp FROM events WHERE user_id % 2 = 0 GROUP BY user_id")],
        f"SELECT event_id AS token, user_id, {rnd(f'value / coalesce(temp, {PARAMS.temp})')} AS t_val"
        " FROM events LEFT JOIN p USING (user_id)",
    ),
    "min_p": query(
        [EV, ("p", softmax("ev", "user_id", "t_val")), ("m", best("p", "user_id"))],
        f"SELECT user_id, token, {PROB9} FROM m",
    ),
    "top_k": query(
        [EV, ("p", softmax("ev", "user_id", "t_val")), ("m", first_k("p", "user_id", 10))],
        f"SELECT user_id, token, {PROB9} FROM m",
    ),
    "top_p": query(
        [EV, ("p", softmax("ev", "user_id", "t_val")), ("m", nucleus("p", "user_id"))],
        f"SELECT user_id, token, {PROB9} FROM m",
    ),
    "top_p_hot": query(
        [EV, ("p", softmax("ev", "event_type", "t_val")), ("m", nucleus("p", "event_type"))],
        f"SELECT event_type, token, {PROB9} FROM m",
    ),
    "nucleus_lines": query(
        [("ln", "SELECT l_returnflag, l_orderkey * 8 + l_linenumber AS token, l_extendedprice / 20000.0::DOUBLE AS t_val"
                " FROM lineitem"),
         ("p", softmax("ln", "l_returnflag", "t_val")), ("m", nucleus("p", "l_returnflag"))],
        f"SELECT l_returnflag, token, {PROB9} FROM m",
    ),
    "uniform_draw": f"SELECT event_id, {rnd(uniform('event_id', 'event_type'))} AS u FROM events",
    "gumbel_sample": query([EV], draw("ev", ["user_id"])),
    "filter_logits": query([X, LOGITS, *chain("lg")], f"SELECT seq_id, token, {PROB9} FROM tp"),
    "filter_with_params": query([X, LOGITS, *chain("lg", p=BY_ROW)], f"SELECT seq_id, token, {PROB9} FROM tp"),
    "score_and_sample": query([X, LOGITS, *chain("lg")], draw("tp", ["seq_id"])),
}

# ----------------------------------------------------------------------- text


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def words(text: str, pattern: str) -> str:
    return f"regexp_extract_all({text}, {quoted(pattern)})"


# A line break inside an SQL string is fine for both the pattern and the markup.
PATTERN = TOKEN_PATTERN


def vocab(source: str, size: int) -> list[tuple[str, str]]:
    """Chat vocabulary of (seq_id, text) rows; ends in `vocab`."""
    specials = ", ".join(f"({i}, {quoted(s)})" for i, s in enumerate(SPECIALS))
    names = ", ".join(quoted(s) for s in SPECIALS)
    return [
        ("vw", f"SELECT unnest({words('text', PATTERN)}) AS text FROM {source}"),
        ("vc", f"SELECT text, count(*) AS n FROM vw WHERE text NOT IN ({names}) GROUP BY text"
               f" ORDER BY n DESC, text LIMIT {size - len(SPECIALS)}"),
        ("vocab", f"SELECT row_number() OVER (ORDER BY n DESC, text) - 1 + {len(SPECIALS)} AS token, text FROM vc"
                  f" UNION ALL SELECT * FROM (VALUES {specials}) s(token, text)"),
    ]


def tokens(source: str) -> list[tuple[str, str]]:
    """Tokens of (seq_id, text) rows; ends in `toks`."""
    split = words("text", PATTERN)
    return [
        ("tw", f"SELECT seq_id, unnest({split}) AS w, generate_subscripts({split}, 1) - 1 AS pos FROM {source}"),
        ("toks", f"SELECT seq_id, pos, coalesce(token, {UNK_ID}) AS token FROM tw LEFT JOIN vocab ON text = w"),
    ]


ITEMS = ("items", "SELECT item_id AS seq_id, text FROM benchmark")


def item_tokens(size: int) -> list[tuple[str, str]]:
    return [ITEMS, *vocab("items", size), *tokens("items")]


def doc_words(size: int) -> list[tuple[str, str]]:
    split = words("text", PATTERN)
    return [
        ("dw", f"SELECT doc_id, unnest({split}) AS w, generate_subscripts({split}, 1) - 1 AS pos FROM documents"),
        ("dc", f"SELECT w, count(*) AS n FROM dw GROUP BY w ORDER BY n DESC, w LIMIT {size}"),
        ("dv", "SELECT row_number() OVER (ORDER BY n DESC, w) - 1 AS token, w AS text, n FROM dc"),
        ("dt", f"SELECT doc_id, pos, coalesce(token, {size}) AS token FROM dw LEFT JOIN dv ON text = w"),
    ]


def turn(role: str, text: str, close: str = " || '<|im_end|>' || chr(10)") -> str:
    return f"'<|im_start|>' || {role} || chr(10) || {text}{close}"


SEGMENTS = [
    ("seg", f"SELECT conv_id, turn, {turn('role', 'text')} AS text FROM conversations"
            f" UNION ALL SELECT conv_id, min(turn) - 1, {turn(quoted('system'), quoted(SYSTEM_PROMPT))}"
            " FROM conversations GROUP BY conv_id HAVING count(*) FILTER (role = 'system') = 0"
            " UNION ALL SELECT conv_id, max(turn) + 1, '<|im_start|>assistant' || chr(10)"
            " FROM conversations GROUP BY conv_id"),
    ("chat", "SELECT conv_id AS seq_id, string_agg(text, '' ORDER BY turn) AS text FROM seg GROUP BY conv_id"),
]
RAW_TURNS = ("raw", "SELECT text FROM conversations")
CHAT_TOKENS = [*SEGMENTS, RAW_TURNS, *vocab("raw", TINY.vocab_size), *tokens("chat")]

TEXT = {
    "vocab_build": query(doc_words(DOC_VOCAB), "SELECT token, text, n FROM dv"),
    "load_vocab": "SELECT doc_id AS token, replace(replace('Ġ' || lang || 'Ċ' || text, 'Ġ', ' '), 'Ċ', chr(10)) AS text FROM documents",
    "encode": query(doc_words(DOC_VOCAB), "SELECT doc_id, pos, token FROM dt"),
    "decode_text": query(
        doc_words(DOC_VOCAB),
        "SELECT doc_id AS seq_id, string_agg(text, '' ORDER BY pos) AS text"
        " FROM dt JOIN dv USING (token) GROUP BY doc_id",
    ),
    "text_round_trip": "SELECT doc_id AS seq_id, text FROM documents WHERE text <> ''",
    "chat_render": query(SEGMENTS, "SELECT seq_id AS conv_id, text AS prompt FROM chat"),
    "chat_tokens": query(CHAT_TOKENS, "SELECT seq_id, pos, token FROM toks"),
    "prompt_lengths": query(
        CHAT_TOKENS,
        "SELECT seq_id, count(*) AS prompt_len, count(*) + 100 AS max_pos FROM toks GROUP BY seq_id",
    ),
}

# ---------------------------------------------------------------- token rules


def penalised(logits: str, seen: str, keys: str, pen: str = DEFAULTS["rep_pen"]) -> str:
    return (
        f"SELECT l.* EXCLUDE (val), CASE WHEN s.token IS NULL THEN val"
        f" WHEN val <= 0 THEN val * {pen} ELSE val / {pen} END AS val"
        f" FROM {logits} l LEFT JOIN {seen} s USING ({keys})"
    )


SEEN = ("seen", "SELECT DISTINCT seq_id, token FROM (SELECT *, max(pos) OVER (PARTITION BY seq_id) AS last FROM toks)"
                " WHERE pos >= last - 64 AND token > 16")
SEQ_LOGITS = ("sl", f"SELECT seq_id // {SPAN} AS seq_id, seq_id % {SPAN} AS pos, token, val FROM lg")
ITEM_TOKENS = item_tokens(WIDE.vocab_size)
LOG = ("log", "SELECT seq_id, max(pos) AS last, arg_max(token, pos) AS token, count(*) AS n FROM toks GROUP BY seq_id")

RULES = {
    "repetition_penalty": query(
        [X, LOGITS, *ITEM_TOKENS, SEEN, ("pn", penalised("lg", "seen", "seq_id, token"))],
        f"SELECT seq_id, token, {rnd('val')} AS val FROM pn",
    ),
    "repetition_penalty_at": query(
        [X, LOGITS, SEQ_LOGITS, *ITEM_TOKENS,
         ("seen", "SELECT DISTINCT l.seq_id, l.pos, t.token FROM (SELECT DISTINCT seq_id, pos FROM sl) l"
                  " JOIN toks t ON t.seq_id = l.seq_id AND t.pos BETWEEN l.pos - 4 AND l.pos AND t.token > 16"),
         ("pn", penalised("sl", "seen", "seq_id, pos, token"))],
        f"SELECT seq_id, pos, token, {rnd('val')} AS val FROM pn",
    ),
    "stop_rules": query(
        [*ITEM_TOKENS, LOG],
        "SELECT seq_id, last + 1 AS pos, token, token IN (0, 2, 4) AS stopped,"
        " last >= n - seq_id % 2 AS exhausted FROM log",
    ),
    "next_token": query(
        [X, LOGITS, *ITEM_TOKENS, SEEN, LOG, ("pn", penalised("lg", "seen", "seq_id, token")), *chain("pn"),
         ("live", "SELECT tp.*, last + 1 AS pos FROM tp JOIN log USING (seq_id)"
                  " WHERE log.token NOT IN (0, 2, 5) AND last < n + 100")],
        draw("live", ["seq_id", "pos"]),
    ),
    "choose_token": query(
        [X, LOGITS, SEQ_LOGITS, *ITEM_TOKENS,
         ("s", "SELECT seq_id, pos, token FROM sl QUALIFY row_number() OVER (PARTITION BY seq_id, pos ORDER BY val DESC, token) = 1")],
        "SELECT s.seq_id, s.pos, coalesce(t.token, s.token) AS token FROM s LEFT JOIN toks t USING (seq_id, pos)",
    ),
}

# ---------------------------------------------------------------------- model


def norm(source: str, tensor: str, layer: int) -> str:
    return (
        f"SELECT seq_id, pos, i, val / sqrt(avg(val*val) OVER (PARTITION BY seq_id, pos) + 1e-5)"
        f" * {gain(tensor, layer, 'i')} AS val FROM {source}"
    )


def project(tensor: str, layer: int, n_out: int, source: str) -> str:
    return (
        f"SELECT seq_id, pos, o AS i, sum(val * {element(tensor, layer, 'o', 'i')}) AS val"
        f" FROM {source}, range({n_out}) t(o) GROUP BY seq_id, pos, o"
    )


def add(a: str, b: str) -> str:
    return f"SELECT seq_id, pos, i, a.val + b.val AS val FROM {a} a JOIN {b} b USING (seq_id, pos, i)"


def block(x: str, layer: int, p: str) -> list[tuple[str, str]]:
    """One layer on the long rows `x`; names start with `p`, the result is `{p}x`."""
    c, hd, g = TINY, TINY.head_dim, TINY.gqa_group
    return [
        (f"{p}n", norm(x, "norm", layer)),
        (f"{p}q", project("q", layer, c.q_dim, f"{p}n")), (f"{p}k", project("k", layer, c.kv_dim, f"{p}n")),
        (f"{p}v", project("v", layer, c.kv_dim, f"{p}n")),
        (f"{p}qr", rope(f"{p}q", ["seq_id"], hd)), (f"{p}kr", rope(f"{p}k", ["seq_id"], hd)),
        (f"{p}qh", heads(f"{p}qr", hd)), (f"{p}kh", heads(f"{p}kr", hd)),
        (f"{p}sc", scores(f"{p}qh", f"{p}kh", g, hd)), (f"{p}sm", weights(f"{p}sc")),
        (f"{p}o", mix(f"{p}sm", f"{p}v", g, hd)), (f"{p}d", project("o", layer, c.hidden, f"{p}o")),
        (f"{p}a", add(x, f"{p}d")), (f"{p}m", norm(f"{p}a", "ffn_norm", layer)),
        (f"{p}g", project("gate", layer, c.ffn_dim, f"{p}m")), (f"{p}u", project("up", layer, c.ffn_dim, f"{p}m")),
        (f"{p}h", f"SELECT seq_id, pos, i, g.val / (1 + {clamped('-g.val')}) * u.val AS val"
                  f" FROM {p}g g JOIN {p}u u USING (seq_id, pos, i)"),
        (f"{p}w", project("down", layer, c.hidden, f"{p}h")), (f"{p}x", add(f"{p}a", f"{p}w")),
    ]


def embedding(toks: str) -> str:
    known = f"(CASE WHEN token < {TINY.vocab_size} THEN token ELSE {UNK_ID} END)"
    return f"SELECT seq_id, pos, i, {element('emb', 0, known, 'i')} AS val FROM {toks}, range({TINY.hidden}) t(i)"


def stack(toks: str, p: str) -> list[tuple[str, str]]:
    ctes, x = [(f"{p}e", embedding(toks))], f"{p}e"
    for layer in range(TINY.n_layers):
        ctes += block(x, layer, f"{p}{layer}")
        x = f"{p}{layer}x"
    return [*ctes, (f"{p}f", norm(x, "out_norm", 0))]


PROMPT = item_tokens(TINY.vocab_size)
XPOS = f"SELECT seq_id, pos, i, {rnd('val')} AS val FROM "


def generation(
    steps: int, p_of: dict[str, str], start: str = "SELECT * FROM toks", forced: dict[int, str] = {}
) -> list[tuple[str, str]]:
    """Decode steps unrolled, each with a full pass and no cache; ends in `t{steps}`.

    `p_of` has the settings, `forced` an expression that replaces the token of a step.
    """
    ctes = [*PROMPT, ("t0", start)]
    for s in range(steps):
        t, p = f"t{s}", f"s{s}"
        ctes += stack(t, p)
        ctes += [
            (f"{p}log", f"SELECT seq_id, max(pos) AS last, arg_max(token, pos) AS token FROM {t} GROUP BY seq_id"),
            (f"{p}end", f"SELECT * EXCLUDE (last, token) FROM {p}f JOIN {p}log USING (seq_id)"
                      f" WHERE pos = last AND token NOT IN (0, 2) AND last < {p_of['max_pos']}"),
            (f"{p}lg", project("out", 0, TINY.vocab_size, f"{p}end").replace("o AS i", "o AS token")),
            (f"{p}seen", f"SELECT DISTINCT t.seq_id, t.token FROM {t} t JOIN {p}log l ON t.seq_id = l.seq_id"
                         " WHERE t.pos >= l.last - 64 AND t.token > 16"),
            (f"{p}pn", f"SELECT * REPLACE (pos + 1 AS pos) FROM ({penalised(f'{p}lg', f'{p}seen', 'seq_id, token', p_of['rep_pen'])})"),
        ]
        ctes += [(p + n, _renamed(b, p)) for n, b in chain("pn", "seq_id", p_of)]
        ctes += [(f"t{s + 1}", f"SELECT seq_id, pos, token FROM {t} UNION ALL"
                                 f" SELECT seq_id, pos, {forced.get(s, 'token')} FROM ({draw(p + 'tp', ['seq_id', 'pos'])})")]
    return ctes


def _renamed(body: str, prefix: str) -> str:
    for name in ("pn", "tl", "pr", "mp", "tk"):
        body = body.replace(f"FROM {name}", f"FROM {prefix}{name}")
    return body


STEPS = 3
GREEDY = DEFAULTS | {"top_k": "1"}
MODEL = {
    "embed": query([*PROMPT, ("y", embedding("toks"))], XPOS + "y"),
    "embed_joined": query([*PROMPT, ("y", embedding("toks"))], XPOS + "y"),
    "block_forward": query([*PROMPT, ("e", embedding("toks")), *block("e", 0, "b")], XPOS + "bx"),
    "model_logits": query(
        [*PROMPT, *stack("toks", "p"), ("y", project("out", 0, TINY.vocab_size, "pf"))],
        f"SELECT seq_id, pos, i AS token, {rnd('val')} AS val FROM y",
    ),
    "greedy_generate": query(generation(STEPS, GREEDY), f"SELECT seq_id, pos, token FROM t{STEPS}"),
    "generate_unknown": query(
        generation(2, GREEDY, "SELECT seq_id, pos, CASE WHEN token > 200 THEN token + 1000 ELSE token END AS token FROM toks"),
        "SELECT seq_id, pos, token FROM t2",
    ),
    "long_attention": query(
        [*CHAT_TOKENS, ("e", embedding("toks")), *block("e", 0, "b")],
        XPOS + "ba",
    ),
    "sampled_generate": query(
        generation(STEPS, DEFAULTS), f"SELECT seq_id, pos, token FROM t{STEPS}"
    ),
    "generate_with_params": query(
        generation(STEPS, BY_ROW, forced={1: "CASE WHEN seq_id % 3 = 1 THEN seq_id % 50 + 20 ELSE token END"}),
        f"SELECT seq_id, pos, token FROM t{STEPS}",
    ),
    "answer_items": query(
        generation(STEPS, DEFAULTS),
        f"SELECT g.seq_id, string_agg(v.text, '' ORDER BY g.pos) AS text FROM t{STEPS} g"
        " JOIN vocab v ON v.token = g.token"
        " JOIN (SELECT seq_id, count(*) AS n FROM toks GROUP BY seq_id) c ON c.seq_id = g.seq_id"
        " WHERE g.pos >= c.n GROUP BY g.seq_id",
    ),
}

MODEL["blocked_logits"] = MODEL["model_logits"]

def placed_parts(parts: str, key: str, text: str) -> str:
    """Parts (key, part, text) with the code points in front of each."""
    return (
        f"SELECT {key}, part, coalesce(sum(length(text)) OVER (PARTITION BY {key} ORDER BY part"
        f" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start, text AS {text} FROM ({parts})"
    )


TEXT["chat_parts"] = query(
    SEGMENTS,
    placed_parts(
        "SELECT conv_id, floor(turn / 2)::BIGINT AS part, string_agg(text, '' ORDER BY turn) AS text FROM seg GROUP BY ALL",
        "conv_id", "prompt",
    ),
)
TEXT["decode_parts"] = query(
    doc_words(DOC_VOCAB),
    placed_parts(
        "SELECT doc_id AS seq_id, pos // 100 AS part, string_agg(text, '' ORDER BY pos) AS text"
        " FROM dt JOIN dv USING (token) GROUP BY ALL", "seq_id", "text",
    ),
)
TEXT["encode_long"] = (
    "SELECT doc_id, 0::BIGINT AS pos, min(doc_id) OVER (PARTITION BY text) AS token FROM documents WHERE text <> ''"
)
MODEL["stream_answers"] = MODEL["answer_items"]
MODEL["insert_missing"] = """
WITH stored AS (
  SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey FROM lineitem WHERE l_linenumber <= 2 GROUP BY ALL
), given AS (
  SELECT l_orderkey, l_linenumber, -l_partkey AS l_partkey FROM lineitem
  UNION ALL SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_linenumber = 3
), missing AS (
  SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey FROM given
  WHERE (l_orderkey, l_linenumber) NOT IN (SELECT (l_orderkey, l_linenumber) FROM stored) GROUP BY ALL
)
SELECT l_linenumber, count(*) AS n, sum(l_partkey)::BIGINT AS parts
FROM (SELECT * FROM stored UNION ALL SELECT * FROM missing) GROUP BY l_linenumber
"""
MODEL["blocked_attention"] = MODEL["long_attention"]
CHAT_BLOCK = [*CHAT_TOKENS, ("e", embedding("toks")), *block("e", 0, "b")]
MODEL["chat_scores"] = query(
    CHAT_BLOCK,
    f"SELECT seq_id, pos, head, n, {rnd('top')} AS top, {rnd('prob')} AS prob"
    " FROM (SELECT seq_id, pos, head, count(*) AS n, max(val) AS top FROM bsc GROUP BY ALL)"
    " JOIN (SELECT seq_id, pos, head, max(prob) AS prob FROM bsm GROUP BY ALL) USING (seq_id, pos, head)",
)
MODEL["chat_mix"] = query(
    CHAT_BLOCK, f"SELECT seq_id, pos, i // {TINY.head_dim} AS head, i % {TINY.head_dim} AS i, {rnd('val')} AS val FROM bo"
)

SQL = {**ALGEBRA, **ATTENTION, **SAMPLING, **TEXT, **RULES, **MODEL}
