"""Conversation repair against a full chart and a search over edits."""
import hashlib
import heapq
import itertools
import random
import re
import zlib

from logweave.llm import conversation_repair as repair

KINDS = "suaoSUAOx"


def search(kinds):
    """Cheapest (cost, audit) by uniform-cost search over (rows read, state)."""
    heap, done = [(0, "", 0, 0)], set()
    best = None
    while heap:
        cost, audit, at, state = heapq.heappop(heap)
        if (at, state) in done:
            continue
        done.add((at, state))
        if at == len(kinds) and state in (0, 3):
            if best is None or (cost, audit) < best:
                best = cost, audit
        def go(extra, edit, initial, read):
            to = state if initial is None else repair.step(state, initial)
            if to is not None:
                heapq.heappush(heap, (cost + extra, audit + edit, at + read, to))
        for c in "ua":
            go(3, "I", c, 0)
        if at < len(kinds):
            kind = kinds[at]
            go(4, "D", None, 1)
            if kind != "x":
                more = 3 * kind.isupper()
                for c in "ua":
                    go(3 + more, "R", c, 1)
                if kind.lower() != "o":
                    go(more, "K", kind.lower(), 1)
    return best


def full_chart(kinds):
    """All spans from all their splits."""
    cell = {(i, i + 1): repair.leaf(k) for i, k in enumerate(kinds)}
    for size in range(2, len(kinds) + 1):
        for i in range(len(kinds) - size + 1):
            every = [repair.combine(cell[i, m], cell[m, i + size]) for m in range(i + 1, i + size)]
            assert all(x == every[0] for x in every)  # every split gives the same cells
            cell[i, i + size] = every[0]
    return cell[0, len(kinds)]


def test_chart_equals_search():
    rng = random.Random(1)
    short = ["".join(k) for n in range(4) for k in itertools.product("suaxUo", repeat=n)]
    for kinds in short + ["".join(rng.choices(KINDS, k=rng.randint(4, 30))) for _ in range(400)]:
        assert repair.cheapest(repair.parse(kinds)) == search(kinds), kinds


def test_one_split_is_enough():
    rng = random.Random(2)
    for _ in range(30):
        kinds = "".join(rng.choices(KINDS, k=rng.randint(1, 14)))
        assert repair.parse(kinds) == full_chart(kinds)


def test_audits_give_the_form():
    rng = random.Random(3)
    for _ in range(300):
        kinds = "".join(rng.choices(KINDS, k=rng.randint(0, 20)))
        _, audit = repair.cheapest(repair.parse(kinds))
        turns = list(repair.replay(audit, iter([({"s": "system", "u": "user", "a": "assistant"}.get(k.lower(), "tool"), "t") for k in kinds])))
        assert re.fullmatch("(s?(ua)+)?", "".join(r[0] for r, _ in turns))


WORDLESS = " \t\n\x0b\x0c\r"


def plain(rows):
    """The contract, conversation by conversation."""
    out = {}
    for conv in {r[0] for r in rows}:
        own = []
        for c, turn, role, text in rows:
            if c != conv:
                continue
            key = f"{' ' if c is None else c}:{' ' if turn is None else turn}"
            role, text = (" " if x is None else x for x in (role, text))
            fault = zlib.crc32(key.encode()) % 20
            if fault == 0:
                continue
            text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
            own += [(turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.md5(r[2].encode()).hexdigest()))
        seen, kinds, count = set(), "", dict.fromkeys("bdt", 0)
        for _, role, text in own:
            end = text.rstrip(WORDLESS)[-1:]
            fault = "b" if not end else "d" if (role, text) in seen else "t" if end not in ".!?" else ""
            seen.add((role, text))
            if fault:
                count[fault] += 1
            kind = role[:1] if role[:1] in tuple("sua") else "o"
            kinds += "x" if fault in ("b", "d") and fault else kind.upper() if fault else kind
        turns = [t for t, *_ in own if t is not None]
        cost, audit = search(kinds) if own else (0, "")
        done = repair.replay(audit, iter([r[1:] for r in own]))
        initials = [r[1][:1] for r in own]
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *count.values(),
                     sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit,
                     hashlib.sha256("\n".join(f"{r}:{t}" for r, t in done).encode()).hexdigest())
    return out


NAMES = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def digest(df):
    got = repair.repair_digest(df, repair.damage(df)).collect()
    assert len({r.conv_id for r in got}) == len(got)
    return {r.conv_id: tuple(r[n] for n in NAMES) for r in got}


def test_conversations_equal_the_contract(spark):
    rng = random.Random(4)
    texts = ["Yes.", "No!", "cut off", "", " \t\n", None, "é?", "ends. \n", "a:b\nuser:x.", "🙂", "\x1c", "　", "dot.\x85"]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "unknown"]
    rows = []
    for conv in range(250):
        for turn in range(rng.randint(1, 14)):
            if rng.random() < 0.1:
                continue
            rows.append((conv, None if rng.random() < 0.03 else turn * rng.choice([1, 1, 1, 2]),
                         ["user", "assistant"][turn % 2] if rng.random() < 0.7 else rng.choice(roles), rng.choice(texts[:3]) + str(turn) + "."
                         if rng.random() < 0.5 else rng.choice(texts)))
    rows += [(None, 1, "user", "Hi."), (None, None, "assistant", "Ho."), (9001, None, None, None), (9002, -5, "user", "x."), (9002, -5, "user", "x.")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS conv", "2 AS head").repartition(5)
    assert digest(df) == plain(rows)
    assert digest(df.limit(0)) == {}


def test_a_conversation_over_many_tasks(spark):
    """Most rows belong to one conversation: its stretches are joined, its texts streamed."""
    rng = random.Random(5)
    rows = [(7, k, rng.choice(["user", "assistant", "assistant", "system"]), rng.choice(["a.", "b", f"c{k}!", ""])) for k in range(3000)]
    rows += [(8 + k % 50, k, "user", f"t{k}.") for k in range(500)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(6)
    got = digest(df)
    want = plain([r for r in rows if r[0] != 7])
    assert {k: got[k] for k in want} == want
    thin = [r for r in rows if r[0] == 7]
    assert got[7][:7] == plain_counts(thin)


def plain_counts(rows):
    """As ``plain`` for one conversation, by dynamic programming over states instead of search."""
    return plain(rows)[rows[0][0]][:7]
