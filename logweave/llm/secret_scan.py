"""Secret scans in DataFrame operations only: fixed patterns and sliding-window Shannon entropy.

Candidate strings are the runs of 20 or more characters of ``[A-Za-z0-9+/_=-]`` that hold a digit and a letter.
A window of 20 characters slides over a candidate; the counts per character are updated by the one that
enters and the one that leaves, and with them S = sum c * log2 c, so that the window's entropy is
log2 20 - S / 20.  A candidate is a secret, from end to end, when a window reaches the limit of its
character class (hexadecimal digits; letters and digits of one case; mixed).  The allow-list suppresses whole
values only: identifiers and paths of plain words and short numbers, UUIDs, and values without a window that
reaches the limit and holds no part of a placeholder word.  What a fixed pattern has found is cut out of a candidate, and each
remaining piece of 20 or more characters is a candidate of its own.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The patterns of the base kinds, in their order.
ASSIGN = r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ["assign", "access", "hex", "entropy"]

CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
#: Lengths summed at a time, and characters of a run scanned at a time.
BLOCK, PIECE = 512, 1 << 16
#: What digits of a hex span become while runs are cut: outside CANDIDATE, but still part of an access key.
MARKS = "!#$%&()*,;"
#: Counts held in one long, and the unit in which S is summed.
PER_LONG, UNIT = 12, 1 << 40
#: Alphabet and least entropy (bits) per character class.
CLASSES = {"hex": ("0123456789abcdef", 2.9),
           "single": ("0123456789abcdefghijklmnopqrstuvwxyz+/_=-", 3.5),
           "mixed": ("0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/_=-", 3.7)}
#: Shapes of whole values after leading separators; possessive, so that long values need no backtracking or stack.
ALLOWED = [r"(?i)^[-=_+/]*+[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$",
           r"^[-=_+/]*+(?:(?:[A-Za-z]++|[0-9]{1,4}+)[-_/+=]++)++[A-Za-z]*+[0-9]{0,4}$"]
PLACEHOLDER = r"(?i)example|placeholder|changeme|dummy|sample|xxxxx|00000|12345"


def _literal(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _ends(gaps: str, matches: str) -> str:
    """End of each match: running sums of the lengths of the gaps and matches, first within blocks and then over
    blocks, so that no step copies a long array."""
    block = (f"aggregate(slice(l, int(b * {BLOCK}) + 1, {BLOCK}), struct(0L AS at, cast(array() AS array<bigint>) AS out), "
             f"(z, x) -> struct(z.at + x AS at, array_append(z.out, z.at + x) AS out), z -> z.out)")
    return (f"transform(array(transform({matches}, (m, k) -> cast(length({gaps}[k]) + length(m) AS bigint))), l -> "
            f"aggregate(transform(sequence(0L, (size(l) - 1) div {BLOCK}), b -> {block}), "
            f"struct(0L AS at, cast(array() AS array<array<bigint>>) AS out), (z, e) -> struct(z.at + element_at(e, -1) AS at, "
            f"array_append(z.out, transform(e, x -> x + z.at)) AS out), z -> flatten(z.out)))[0]")


def _filled(text: str, pattern: str, fill: str) -> str:
    """``text`` with ``fill`` (SQL over m) in the place of each match m of the pattern."""
    p = _literal(pattern)
    return (f"transform(array(struct(regexp_extract_all({text}, {p}, 0) AS m, split({text}, {p}, -1) AS g)), x -> concat("
            f"array_join(transform(x.m, (m, k) -> concat(x.g[k], {fill})), ''), element_at(x.g, -1)))[0]")


def window_hits(run: str, alphabet: str, limit: float) -> str:
    """SQL for struct(first, last): first window start and last window end that reach the limit.

    The characters are numbered once.  Counts are at most 20, so twelve of them share a long, five bits each, and
    a step touches no more than a few longs, whatever the alphabet; S is kept in units of 2**-40, so it is exact
    and does not depend on how far the window has come.  The work is linear in the length of the run.
    """
    f = [round(c * math.log2(c) * UNIT) if c else 0 for c in range(WINDOW + 2)]
    most = math.floor(WINDOW * (math.log2(WINDOW) - limit + 1e-9) * UNIT)
    packs = range(-(-len(alphabet) // PER_LONG))
    table = lambda values: "array(" + ",".join(map(str, values)) + ")"  # noqa: E731  (folded to one constant)
    # by character number, 0 for none: its long, its place in it, and what one more of it adds to each long
    pack = table([0] + [k // PER_LONG for k in range(len(alphabet))])
    place = table([5 * PER_LONG] + [5 * (k % PER_LONG) for k in range(len(alphabet))])
    one = [table(["0L"] + [f"{1 << 5 * (k % PER_LONG) if k // PER_LONG == j else 0}L" for k in range(len(alphabet))]) for j in packs]
    more, less = (table(f"{v}L" for v in d) for d in ([f[c + 1] - f[c] for c in range(WINDOW + 1)],
                                                      [0] + [f[c - 1] - f[c] for c in range(1, WINDOW + 1)]))
    count = lambda x: (f"int(shiftright(CASE {pack}[{x}] " + " ".join(f"WHEN {j} THEN a.w{j}" for j in packs)
                       + f" END, {place}[{x}]) & 31L)")
    total = f"CASE WHEN z.o = z.n THEN a.s ELSE a.s + {more}[{count('z.n')}] + {less}[{count('z.o')}] END"
    counts = ", ".join(f"a.w{j} + {one[j]}[z.n] - {one[j]}[z.o] AS w{j}" for j in packs)
    reach = f"i >= {WINDOW - 1} AND s <= {most}L"
    # one-element arrays hold intermediate values, so that each is computed once
    step = (f"transform(array(struct(c[i] AS n, CASE WHEN i >= {WINDOW} THEN c[i - {WINDOW}] ELSE 0 END AS o)), "
            f"z -> transform(array({total}), s -> struct({counts}, s AS s, "
            f"CASE WHEN a.first < 0 AND {reach} THEN i - {WINDOW - 1} ELSE a.first END AS first, "
            f"CASE WHEN {reach} THEN i + 1 ELSE a.last END AS last))[0])[0]")
    scan = (f"CASE WHEN size(c) >= {WINDOW} THEN aggregate(sequence(0, size(c) - 1), "
            f"struct({', '.join(f'0L AS w{j}' for j in packs)}, 0L AS s, -1 AS first, -1 AS last), (a, i) -> {step}, "
            f"a -> struct(a.first AS first, a.last AS last)) ELSE struct(-1 AS first, -1 AS last) END")
    return f"transform(array(transform(split({run}, ''), x -> instr('{alphabet}', x))), c -> {scan})[0]"


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row of ``docs`` with all its columns and ``secrets``: array of structs (start, rank, kind, end)
    sorted by start and kind; code points, end exclusive.  A null or empty text has no spans;
    an input column named ``secrets`` is replaced.

    Kinds: ``assign`` is the value (6 characters or more) of a password, secret, token or key assignment;
    ``access`` a cloud access key; ``hex`` 24 or more hexadecimal digits; ``entropy`` the method's own.
    """
    text = "coalesce(cast(_text AS string), '')"
    docs = docs.drop("secrets")
    rows = docs.select(F.struct("*").alias("_all"), F.col(text_col).alias("_text"))
    rows = rows.selectExpr("_all", f"{text} AS t")
    found = {"assign": ASSIGN, "access": ACCESS, "hex": HEX}
    rows = rows.selectExpr("_all", "t", *(f"regexp_extract_all(t, {_literal(p)}, 0) AS {k}_m" for k, p in found.items()),
                           f"regexp_extract_all(t, {_literal(CANDIDATE)}, 0) AS run_m")
    usable = "m rlike '[0-9]' AND m rlike '[A-Za-z]'"
    rows = rows.selectExpr("*", *(f"CASE WHEN size({k}_m) > 0 THEN split(t, {_literal(p)}, -1) END AS {k}_g" for k, p in found.items()),
                           f"CASE WHEN size(assign_m) > 0 THEN regexp_extract_all(t, {_literal(ASSIGN)}, 2) END AS assign_v")
    rows = rows.selectExpr("*", *(f"CASE WHEN {k}_g IS NOT NULL THEN {_ends(f'{k}_g', f'{k}_m')} END AS {k}_e" for k in found))

    def spans(kind: str, value: str, least: int) -> str:
        rank = KINDS.index(kind)
        return (f"coalesce(filter(transform({kind}_e, (e, k) -> struct(e - length({value}[k]) AS start, {rank} AS rank, "
                f"'{kind}' AS kind, e AS end)), x -> x.end - x.start >= {least}), array())")
    rows = rows.selectExpr("_all", "t", f"concat({spans('assign', 'assign_v', 6)}, {spans('access', 'access_m', 20)}, "
                                        f"{spans('hex', 'hex_m', 24)}) AS base", f"exists(run_m, m -> {usable}) AS some")
    # Base spans become characters outside a candidate, one for one, so that the runs of the new text are the pieces between
    # them.  A value ends where its class ends and no hex digit or key character stands before it, so the other kinds lie
    # within it or apart from it; an access key and a hex span may share digits, which is why those are marked.
    value = (f"transform(array(length(regexp_extract(m, {_literal(ASSIGN)}, 2))), v -> CASE WHEN v >= 6 "
             f"THEN concat(substring(m, 1, length(m) - v), repeat(' ', v)) ELSE m END)[0]")
    cut = "CASE WHEN some AND size(base) > 0 THEN {0} WHEN some THEN t END AS t"
    steps = [f"translate({_filled('t', ASSIGN, value)}, {_literal(MARKS)}, repeat(' ', {len(MARKS)}))",
             _filled("t", HEX, f"translate(m, '0123456789abcdef', {_literal(MARKS + ' ' * 6)})"),
             _filled("t", ACCESS.replace("0-9", "0-9" + MARKS), "repeat(' ', length(m))")]
    for step in steps:
        rows = rows.selectExpr("_all", "base", "some", cut.format(step))
    rows = rows.selectExpr("_all", "base", *(f"CASE WHEN t IS NOT NULL THEN {x} END AS run_{n}" for n, x in (
        ("m", f"regexp_extract_all(t, {_literal(CANDIDATE)}, 0)"), ("g", f"split(t, {_literal(CANDIDATE)}, -1)"))))
    rows = rows.selectExpr("_all", "base", "run_m", f"CASE WHEN size(run_m) > 0 THEN {_ends('run_g', 'run_m')} END AS run_e")
    usable = usable.replace("m rlike", "r.m rlike")
    rows = rows.selectExpr("_all", "base", f"CASE WHEN run_e IS NOT NULL THEN filter(transform(run_m, (m, k) -> struct(m, "
                                           f"run_e[k] - length(m) AS start, run_e[k] AS end)), r -> {usable}) END AS runs")
    ok = " AND ".join(f"NOT r.m rlike {_literal(p)}" for p in ALLOWED)
    rows = rows.selectExpr("_all", "base", f"transform(filter(runs, r -> {ok}), r -> struct(r.m, r.start, r.end, "
                                           f"CASE WHEN r.m rlike '^[0-9a-f]+$' OR r.m rlike '^[0-9A-F]+$' THEN 'hex' "
                                           f"WHEN r.m rlike '[a-z]' AND r.m rlike '[A-Z]' THEN 'mixed' ELSE 'single' END AS class)) AS runs")

    def reached(m: str) -> str:
        # in pieces that share all but one character of a window, so that only one piece is held as single characters
        pieces = f"transform(sequence(0, int((length({m}) - 1) div {PIECE})), b -> substring({m}, b * {PIECE} + 1, {PIECE + WINDOW - 1}))"
        return f"exists({pieces}, p -> (CASE" + "".join(
            f" WHEN r.class = '{c}' THEN " + window_hits("p" if c == "mixed" else "lower(p)", a, h)
            for c, (a, h) in CLASSES.items()) + " END).last >= 0)"
    # a placeholder word excuses the windows that touch it, not the rest of the run
    rows = rows.selectExpr("_all", "base", f"filter(runs, r -> NOT r.m rlike {_literal(PLACEHOLDER)} OR exists("
                                           f"filter(split(r.m, {_literal(PLACEHOLDER)}, -1), q -> length(q) >= {WINDOW}), "
                                           f"q -> {reached('q')})) AS runs")
    rows = rows.selectExpr("_all", "base", f"CASE WHEN size(runs) > 0 THEN filter(runs, r -> {reached('r.m')}) ELSE array() END AS hits")
    extra = f"transform(hits, h -> struct(h.start, {KINDS.index('entropy')} AS rank, 'entropy' AS kind, h.end))"
    return rows.selectExpr("_all.*", f"sort_array(concat(base, {extra})) AS secrets")


def span_digest(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per row: id, counts of the base kinds, the digest of the base spans and all spans as text."""
    joined = "array_join(transform({0}, x -> concat(x.kind, ':', x.start, ':', x.end)), ',')"
    count = "cast(size(filter(secrets, x -> x.kind = '{0}')) AS long) AS n_{0}"
    return scanned.selectExpr(f"`{id_col}`", *(count.format(k) for k in KINDS[:3]),
                              f"sha2({joined.format('filter(secrets, x -> x.rank < 3)')}, 256) AS base_sha256",
                              f"{joined.format('secrets')} AS spans")


def redact(scanned: DataFrame, text_col: str = "text", marker: str = "[SECRET]") -> DataFrame:
    """Replace the secrets of ``secret_spans`` in the text (overlapping spans once) and drop the column."""
    text = f"""CASE WHEN size(secrets) = 0 THEN `{text_col}` ELSE aggregate(secrets,
        struct(0L AS at, '' AS done),
        (a, x) -> CASE WHEN x.start >= a.at THEN struct(x.end AS at,
            concat(a.done, substring(`{text_col}`, int(a.at) + 1, int(x.start - a.at)), '{marker}') AS done)
          ELSE struct(greatest(a.at, x.end) AS at, a.done AS done) END,
        a -> concat(a.done, substring(`{text_col}`, int(a.at) + 1))) END"""
    return scanned.withColumn(text_col, F.expr(text)).drop("secrets")
