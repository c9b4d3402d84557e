import re

import pytest

from docketlake.llm.pii_bootstrap import find_identifiers, luhn, seed_type, shape, windows


@pytest.mark.parametrize(
    ("instance", "before", "kind"),
    [
        ("a.b@c.example.org", [], "email"), ("10.2.3.4", [], "ip"), ("999.2.3.4", [], None), ("+1 (222) 333-4444", [], "phone"), ("123-45-6789", [], "ssn"),
        ("4539578763621486", [], "card"), ("4539578763621487", [], None), ("4539 5787 6362 1486", [], "card"), ("212-555-0147", [], "phone"), ("+442079460958", [], "phone"), ("2020-01-01", [], None), ("GB82 WEST 1234 5698 7654 32", [], "iban"), ("GB82WEST12345698765433", [], None), ("ab12" * 10, ["token", "="], "secret"), ("ab12" * 10, ["x", "y"], None), ("2.0", [], "none"), ("1234567", [], None),
    ],
)
def test_seeds(instance, before, kind):
    assert seed_type(instance, before) == kind


def test_shapes_and_windows():
    assert shape("ab-12.3", True) == "a2-d2.d1" and shape("ab-12.3", False) == "a-d.d" and shape("0f" * 10, True) == "x20"
    assert luhn("4539578763621486") and not luhn("4539578763621487")
    got = windows(["+1!!", "(222)!!", "333-4444."])
    assert (0, 3, "+1 (222) 333-4444") in got and len(got) == 6
    assert [w for w in windows(["1.2.3.4,", "5.6.7.8"]) if w[1] > 1] == []


def plain_candidates(text):
    """Windows of adjacent words with a digit or @, written out for one text: (word, n, instance, before, after)."""
    words = text.split()
    found = []
    for i in range(len(words)):
        for n in range(1, 7):
            held = words[i : i + n]
            if len(held) < n or not all(any(c in "0123456789@" for c in w) for w in held):
                break
            bare = [w.strip("!#$%&*") for w in held]
            if any(w and w[-1] in ",.;:?" for w in bare[:-1]):
                break
            instance = " ".join(bare).strip("!#$%&*,.;:?'\"()[]{}<>")
            if instance:
                found.append((i, n, instance, words[max(0, i - 2) : i], words[i + n : i + n + 1]))
    return found


def plain_patterns(instance, before, after):
    def coded(exact):
        if len(instance) >= 16 and all(c in "0123456789abcdefABCDEF" for c in instance) and any(c.isdigit() for c in instance) and any(c.isalpha() for c in instance):
            return f"x{len(instance)}" if exact else "x"
        out, i = "", 0
        while i < len(instance):
            kind = str.isdigit if instance[i].isdigit() else str.isalpha
            j = i
            while j < len(instance) and kind(instance[j]):
                j += 1
            if j == i:
                out, j = out + instance[i], i + 1
            elif kind is str.isdigit:
                out += f"d{j - i}" if exact else next(c for c, most in (("d", 4), ("D", 8), ("E", 12), ("F", 19), ("G", 10**9)) if j - i <= most)
            else:
                out += f"a{j - i}" if exact else "a"
            i = j
        return out

    def side(w):
        return re.sub("[0-9]+", "0", w[0].lower().strip("!#$%&*,.;:?'\"()[]{}<>")) if w else ""

    k = coded(False)
    return {f"exact {coded(True)}", f"shape {k}", f"after {side(before[-1:])} {k}", f"before {side(after)} {k}"}


def brute(rows, confidence, support):
    """The same bootstrapping over dictionaries: rows of (instance, seed, patterns)."""
    known = {}
    for instance, seed, _ in sorted(rows, key=lambda r: (r[1] is None, r[1] == "none", r[1] or "")):
        if seed:
            known.setdefault(instance, seed)
    edges = {(i, p) for i, _, ps in rows for p in ps}
    believed, seen = {i: (t, 1.0) for i, t in known.items()}, []
    while believed not in seen:
        seen.append(believed)
        weight = {}
        for i, p in edges:
            if i in believed:
                weight.setdefault(p, {}).setdefault(believed[i][0], []).append(believed[i][1])
        good = {}
        for p, by in weight.items():
            total = sum(sum(v) for v in by.values())
            for t, v in by.items():
                if t != "none" and sum(v) >= support and sum(v) / total >= confidence:
                    good[p] = (t, sum(v) / total)
        doubt = {}
        for i, p in edges:
            if p in good:
                t, share = good[p]
                doubt[i, t] = doubt.get((i, t), 1.0) * max(1 - share, 0.01)
        new = {}
        for (i, t), d in sorted(doubt.items()):
            score = round(1 - d, 6)
            if i not in known and score >= confidence and score > new.get(i, ("", 0))[1]:
                new[i] = (t, score)
        believed = {i: (t, 1.0) for i, t in known.items()} | new
    return {i: t for i, (t, _) in believed.items() if t != "none"}


CARDS = ["4539578763621486", "4716059238263215", "4929718094872915", "4024007198964305", "5425233430109903"]


def test_discovery_against_brute_force(spark):
    texts = [f"pay by card {c} now" for c in CARDS if luhn(c)] + ["card 4539578763621480 here", "later 4539578763621489", "version 2.0 of 1999", "member no 77-1234567x", "badge 88-7654321y"]
    texts += [f"member no 5{i}-{i}234567x" for i in range(4)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    given = spark.createDataFrame([(f"5{i}-{i}234567x", "member") for i in range(4)], "entity string, type string")
    rows = [(x, "member" if x.startswith("5") and x.endswith("x") else seed_type(x, before), plain_patterns(x, before, after)) for t in texts for _, _, x, before, after in plain_candidates(t)]
    got = {r.entity: r.type for r in find_identifiers(docs, given).collect()}
    assert got == brute(rows, 0.8, 3.0)
    assert got["4539578763621480"] == "card" and got["4539578763621489"] == "card" and got["77-1234567x"] == "member"
    assert not {"2.0", "1999"} & set(got)


def test_names_are_discovered_where_known_names_stand(spark):
    names = ["Anna Krull", "Bertil Ostman", "Carla Neri", "Dorian Wex"]
    texts = [f"The claim was lodged by Ms {n} , domiciled in the north." for n in [*names, "Edda Quist", "Fedor Ilin", "Gita Rao"]]
    texts += ["The court sat in the north and the claim was heard.", "It was lodged by the clerk."] * 3
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    given = spark.createDataFrame([(n, "name") for n in names], "entity string, type string")
    got = {(r.entity, r.type) for r in find_identifiers(docs, given).collect()}
    assert got == {(n, "name") for n in [*names, "Edda Quist", "Fedor Ilin", "Gita Rao"]}
    assert find_identifiers(docs).collect() == []


def test_texts_of_one_key_and_of_none_keep_their_own_mentions(spark):
    rows = [(None, "call +1 (222) 333-4444 now"), (None, "at 10.9.8.7"), (None, "mail a.b@c.example.org"), (1, "call +1 (222) 333-4444 now"), (1, "host is 10.9.8.7 here")]
    got = find_identifiers(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.entity) for r in got) == sorted([("None", "+1 (222) 333-4444"), ("None", "10.9.8.7"), ("None", "a.b@c.example.org"), ("1", "+1 (222) 333-4444"), ("1", "10.9.8.7")])


def test_odd_rows(spark):
    text = "Mail a.b@c.example.org and +1 (222) 333-4444!! or 10.2.3.4, 10.2.3.5."
    rows = [(1, text, "x"), (1, text, "x"), (2, None, "x"), (3, "", "x"), (None, "at 10.9.8.7", "x"), (4, "plain words", None), (5, "w " * 40000 + "z@y.example.com", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, type string")
    got = find_identifiers(docs).collect()
    one = sorted((r.first_word, r.n_words, r.entity) for r in got if r.doc_id == 1)
    assert one == sorted([(1, 1, "a.b@c.example.org"), (3, 3, "+1 (222) 333-4444"), (7, 1, "10.2.3.4"), (8, 1, "10.2.3.5")] * 2)
    assert [(r.entity, r.first_word) for r in got if r.doc_id == 5] == [("z@y.example.com", 40000)]
    assert {r.doc_id for r in got} == {1, 5, None}
    assert find_identifiers(spark.createDataFrame([], docs.schema)).collect() == []
