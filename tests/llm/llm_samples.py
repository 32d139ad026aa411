"""Helpers of the tests of the training-data operators."""
import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def prose(n, seed):
    rng = random.Random(seed)
    return " ".join(rng.choice("alpha beta gamma delta river stone cloud paper green light music seven".split())
                    + rng.choice(["", "s", "ed", "ing", "ly"]) for _ in range(n))
