"""Frequent lines, depletion and ``kept`` against brute force; limits do not follow the size of a host."""
import collections
import random

from logweave.llm import line_frequency as lf

from llm_samples import WORD, prose


def normal(line):
    return "".join("0" if c in "0123456789" else c for c in line.lower() if c not in " \t\x0b\f\r")


def brute(rows, voters, share=0.01, least=10, keep_share=0.3, host_limits=lf.HOST_LIMITS, corpus_limits=lf.CORPUS_LIMITS):
    host_votes, votes, docs = collections.defaultdict(set), collections.defaultdict(set), collections.defaultdict(set)
    held = {}
    for k, text, host in rows:
        lines = [x for x in text.split("\n") if WORD.search(x)]
        held[k] = [(normal(x), len(WORD.findall(x))) for x in lines]
        docs[host].add(voters[k])
        for line, _ in held[k]:
            host_votes[host, line].add(voters[k])
            votes[line].add(voters[k])
    out = {}
    for k, text, host in rows:
        def frequent(line, words):
            own = len(host_votes[host, line])
            return own >= host_limits[words < lf.LONG_WORDS] or len(votes[line]) >= corpus_limits[words < lf.LONG_WORDS] \
                or own >= least and own > share * len(docs[host])
        gone = [(line, w) for line, w in held[k] if frequent(line, w)]
        words = WORD.findall(text)
        n, windows = len(words), [tuple(words[j:j + 3]) for j in range(len(words) - 2)]
        twice = collections.Counter(windows)
        repeated = len({j + i for j, w in enumerate(windows) if twice[w] > 1 for i in range(3)})
        left = n - sum(w for _, w in gone)
        out[k] = len(gone), left, n >= 50 and 100 * repeated <= 50 * n and left >= keep_share * n and left >= 20
    return out


def judged(spark, rows, **limits):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    return {r.doc_id: r for r in lf.line_frequency(df, **limits).collect()}


def test_equal_to_brute_force_where_documents_are_rejected(spark):
    """Boilerplate of several lengths in hosts of several sizes, some documents made of little else."""
    rng = random.Random(1)
    notices = [f"notice {k}: " + prose(rng.choice([2, 4, 9, 14]), 900 + k) for k in range(12)]
    rows = []
    for k in range(900):
        own = [prose(rng.randint(6, 30), 10_000 + 7 * k + j) for j in range(rng.choice([1, 1, 2, 5]))]
        own += rng.sample(notices, rng.choice([0, 1, 2, 10]))
        rng.shuffle(own)
        rows.append((k, "\n".join(own), rng.choice(["big", "big", "big", "mid", f"small{k % 40}"])))
    longest = sorted(notices, key=len)[-6:]
    rows += [(900 + k, "\n".join([prose(8, 50_000 + k), *longest]), "big") for k in range(40)]  # little of their own
    limits = dict(host_limits=(12, 20), corpus_limits=(30, 40), share=0.05, least=8, keep_share=0.5)
    got = judged(spark, rows, **limits)
    measured = lf.text_measures(spark.createDataFrame([(k, 0, k, t) for k, t, _ in rows], "row long, host long, id long, text string"))
    voters = {r.id: r.voter for r in measured.collect()}
    want = brute(rows, voters, **limits)
    assert {k: (r.n_frequent_lines, r.n_words_left, r.kept) for k, r in got.items()} == want
    rejected = [k for k, r in got.items() if not r.kept and not r.base_failed]
    assert len(rejected) > 20 and sum(w[0] > 0 for w in want.values()) > 200


def test_hosts_of_any_size_are_judged_alike(spark):
    """A passage in 60 documents of a host counts whether the host has 500 documents or many more; and so does one in 75 documents
    spread over 20 hosts; 75 copies of one document do not make its lines frequent."""
    passage, spread = "You may copy this text under the terms of the licence given here", "This text may be shared by all who name where it is from"
    rows = []
    for host, size in (("small", 500), ("large", 7000)):
        rows += [(len(rows) + k, prose(60, len(rows) + k) + ("\n" + passage if k < 60 else ""), host) for k in range(size)]
    first = len(rows)
    rows += [(first + k, prose(60, first + k) + "\n" + spread, f"h{k % 20}") for k in range(75)]
    near = len(rows)
    base = [prose(14, 77_000 + j) for j in range(12)]
    rows += [(near + k, "\n".join([*base, f"copy w{k} " + prose(9, k)]), "copies") for k in range(75)]
    got = judged(spark, rows)
    assert all(r.n_frequent_lines == (1 if passage in t or spread in t else 0) for k, t, _ in rows[:near] for r in [got[k]])
    assert all(got[k].kept for k, _, _ in rows[near:])
