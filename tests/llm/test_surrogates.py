"""Surrogates: full formats, missed forms, names of one person."""
import ipaddress
import random
import re

from logweave.llm import surrogates as su


def replaced(spark, texts, key=b"k"):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.text for r in su.replace_entities(df, key).collect()}
    return [got[k] for k in range(len(texts))]


def test_full_formats_are_widened(spark):
    """400 of 676 addresses of one form, and nearly all of a /16: every entity gets a surrogate of its own."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    mails = [f"{a}@{b}.com" for a in letters for b in letters][:400]
    ips = [f"192.168.{a}.{b}" for a in range(1, 254) for b in range(1, 254)][:64_000]
    texts = [f"mail {m} end" for m in mails] + ["ips " + " , ".join(ips[k:k + 500]) for k in range(0, len(ips), 500)]
    out = replaced(spark, texts)
    new = [re.search(r"mail (\S+) end", t)[1] for t in out[:400]]
    assert len(set(new)) == 400 and not set(new) & set(mails)
    fresh = [x for t in out[400:] for x in t[4:].split(" , ")]
    assert len(set(fresh)) == len(ips) == len(fresh) and not set(fresh) & set(ips)


def test_forms_that_were_missed(spark):
    texts = ["call +14155552671 now", "call +4930901820 now", "call +33 1 23 45 67 89 now", "call 01 23 45 67 89 now", "write _bob@example.com now",
             "Mr. محمد علي came", "at 2001:db8::8a2e:370:7334 now", "at 2001:0DB8:0000:0000:0000:8A2E:0370:7334 now", "Mr O'Brien came",
             "+1 (826) 555-4081 190.137.1.2", "+1 (826) 555-4081 1234 x",
             "Mrs de Souza came", "Herr Ludwig van Beethoven came", "श्री"]
    real = ["14155552671", "4930901820", "1 23 45 67 89", "01 23 45 67 89", "_bob@", "محمد", "8a2e:370:7334", "8A2E:0370:7334", "Brien", "555-4081 190.137.1.2", "555-4081",
            "\x00", "Beethoven", "\x00"]
    out = replaced(spark, texts)
    for text, old, new in zip(texts, real, out):
        assert old not in new, text
        assert (new == text) == (old == "\x00")
    assert re.fullmatch(r"call \+\d{11} now", out[0]) and re.fullmatch(r"call \+33 \d \d\d \d\d \d\d \d\d now", out[2])
    assert re.fullmatch(r"at 2001:[0-9A-F:]{34} now", out[7]) and ipaddress.IPv6Address(out[6].split()[1])
    assert ipaddress.IPv6Address(out[6].split()[1]) == ipaddress.IPv6Address(out[7].split()[1])
    assert all("؀" <= c <= "ۿ" for c in out[5].split()[1])


def test_plain_numbers_and_times_stay(spark):
    texts = ["at 12:30:45 on 2024-01-02", "version 1.2.3 of 10", "a::b and std::vector", "12 34 56", "from 1990 to 2020", "+1 or +2", "::1 is home"]
    assert replaced(spark, texts) == texts


def name_of(text, pattern):
    return re.search(pattern, text)[1]


def test_one_person_one_surrogate(spark):
    out = replaced(spark, ["Mr John Smith came. John Smith left. Smith said. John's hat. Mr Smith slept.",
                           "Dr Anna Schmidt spoke.", "Frau Anna Schmidt sang. Schmidt won.", "Mr Smith alone.",
                           "Mr John Smith and Mrs Mary Smith. Mrs Smith ran. Mr Smith sat.", "Blacksmith Smithson, John"])
    m = re.fullmatch(r"Mr (\w+) (\w+) came\. (\w+) (\w+) left\. (\w+) said\. (\w+)'s hat\. Mr (\w+) slept\.", out[0]).groups()
    assert m[0] == m[2] == m[5] and m[1] == m[3] == m[4] == m[6] and "Smith" not in out[0] and "John" not in out[0]
    assert m[0] in su.GIVEN["latin", "m"]
    first, family = re.fullmatch(r"Dr (\w+) (\w+) spoke\.", out[1]).groups()
    assert re.fullmatch(r"Frau (\w+) (\w+) sang\. (\w+) won\.", out[2]).groups() == (first, family, family)
    assert first in su.GIVEN["latin", "f"]                       # learnt from another text's title
    assert "Smith" not in out[3]
    two = re.fullmatch(r"Mr (\w+) (\w+) and Mrs (\w+) (\w+)\. Mrs (\w+) ran\. Mr (\w+) sat\.", out[4]).groups()
    assert two[:2] == m[:2] and two[4] == two[3] and two[5] == two[1] and two[2] in su.GIVEN["latin", "f"]
    assert out[5] == "Blacksmith Smithson, John"                  # no title in this text


def test_coreference_against_brute_force(spark):
    """Random texts over few people: the surrogates of mentions agree exactly where the people do."""
    rng = random.Random(3)
    given = {"m": ["Zoran", "Quentin"], "f": ["Yvette", "Xenia"]}
    family = ["Abercrombie", "Featherstone", "O'Hara", "Lloyd-Webber"]
    texts, truth = [], []
    for _ in range(60):
        gender = rng.choice("mf")
        who = (rng.choice(given[gender]), rng.choice(family))
        forms = [lambda: (f"{'Mr' if gender == 'm' else 'Mrs'} {who[0]} {who[1]}", 2), lambda: (f"Dr {who[0]} {who[1]}", 2),
                 lambda: (f"{who[0]} {who[1]}", 2), lambda: (who[1], 1), lambda: (f"{'Mr' if gender == 'm' else 'Ms'} {who[1]}", 1)]
        picks = [forms[rng.choice([0, 1])]()] + [rng.choice(forms)() for _ in range(4)]
        texts.append(" ; ".join(p for p, _ in picks))
        truth.append((who, gender, [n for _, n in picks]))
    out = replaced(spark, texts)
    names = {}
    for text, new, (who, gender, sizes) in zip(texts, out, truth):
        assert not any(w in new for w in who)
        parts = [re.sub(r"^(Mr|Mrs|Ms|Dr) ", "", p) for p in new.split(" ; ")]
        full = {p for p, n in zip(parts, sizes) if n == 2}
        assert len(full) == 1
        name = full.pop()
        assert all(p == name.split(" ", 1)[1] for p, n in zip(parts, sizes) if n == 1)
        assert names.setdefault(who, name) == name
    assert len(set(names.values())) == len(names)
    titled = {who: gender for (who, gender, _), t in zip(truth, texts) if "Mr" in t or "Ms" in t}
    assert all(names[w].split()[0] in su.GIVEN["latin", g] for w, g in titled.items())
