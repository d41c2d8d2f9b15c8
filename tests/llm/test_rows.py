"""Operators that look at one row at a time, mixing, sharding, decontamination."""

import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ebbtide.llm import decontaminate, mixing, pii, sharding

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def base_spans(t):
    out = []
    for kind, p in PATTERNS.items():
        for m in re.finditer(p, t or ""):
            d = re.sub("[^0-9]", "", m.group())
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m.group().split(".") if kind == "ip"),
                  "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


ODD_TEXTS = ["", None, "x@y.zz", "a@b.c_d@e.f g@h", "été 漢字 😀 me@ex-a.co.uk, 1.2.3.4.5.6.7.8", "256.1.1.1 1.1.1.256 0.0.0.0 00255.1.2.3",
             "4111 1111 1111 1111 and 4111-1111-1111-1112", "4111  1111 1111 1111", "+1 (555) 123-4567. +12 +1234567890123456",
             "IBAN GB82WEST12345698765432 GB82WEST12345698765433", "my ssn 123-45-6789, part 123-45-6789", "a" * 50_000 + "@", "1" * 30_000,
             "1 " * 9_000, "1.2.3.4 " * 3_000, "a@b" + ".c" * 9_000, "+" * 5_000 + "1" * 20]


def test_pii_base_spans_equal_plain_matching(docs):
    rnd = random.Random(4)
    parts = ["me@a.b", "1.2.3.4", "300.1.1.1", "4111111111111111", "+49 30 1234567", " ", "-", ".", "@", "é", "9", "\n", "word", "+", "()"]
    texts = ODD_TEXTS + ["".join(rnd.choice(parts) for _ in range(rnd.randint(1, 40))) for _ in range(300)]
    got = {r.doc_id: r for r in pii.digest(pii.find_pii(docs(texts))).collect()}
    for i, t in enumerate(texts):
        want = base_spans(t)
        line = ",".join(f"{k}:{s}:{e}" for k, s, e in want)
        assert [got[i][f"n_{k}"] for k in PATTERNS] == [sum(x[0] == k for x in want) for k in PATTERNS], t and t[:80]
        assert got[i].base_sha256 == hashlib.sha256(line.encode()).hexdigest(), t and t[:80]
        assert got[i].spans.startswith(line)
    assert "iban:5:27" in got[9].spans and "iban:28" not in got[9].spans
    assert got[10].spans == "ssn:7:18"
    assert pii.find_pii(docs([])).count() == 0


def test_mask(docs):
    out = [r.text for r in pii.mask_pii(docs(["write me@a.bc now", "plain", None])).orderBy("doc_id").collect()]
    assert out == ["write <EMAIL> now", "plain", None]


def fill(sizes, weights, cap):
    """Targets by sharing out again until none is above its cap."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    done = {}
    while True:
        rest = sum(sizes.values()) - sum(done.values())
        free = [s for s in names if s not in done]
        share = {s: rest * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if share[s] > cap * sizes[s]]
        if not over:
            return done | share
        done |= {s: cap * sizes[s] for s in over}


def test_mix_targets_and_copies(spark, docs):
    rnd = random.Random(2)
    rows = [(i, " ".join(["w"] * rnd.randint(0, 60)), rnd.choice(["a", "b", "c", "é", None, "zz"] + ["hot"] * 6)) for i in range(900)]
    rows += [(None, "x y", "a"), (7, "dup row", "b"), (7, "dup row", "b"), (8, None, "void")]
    df = docs([]).select("doc_id", "text", "source").union(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    out = mixing.mix(df).collect()
    sizes = Counter()
    for k, t, s in rows:
        sizes[s] += len((t or "").split())
    want, taken = fill(dict(sizes), (5, 2, 1), 3), Counter()
    for r in out:
        assert r["__source_size"] == sizes[r.source] and r["__target"] == pytest.approx(want[r.source])
        assert 0 <= r["__copies"] <= 3 and r["__size"] == len((r.text or "").split())
        taken[r.source] += r["__copies"] * r["__size"]
    assert len(out) == len(rows)
    for s, t in want.items():
        assert abs(taken[s] - t) <= max(90, 0.05 * t)
    again = mixing.mix(df.repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, out))
    assert mixing.mixed(df).columns == df.columns and mixing.mixed(df).count() == sum(r["__copies"] for r in out)
    assert mixing.mix(docs([])).count() == 0


def test_shards_fit_and_hold_every_row(docs):
    rnd = random.Random(6)
    rows = [(i, "x" * rnd.randint(0, 300)) for i in range(800)] + [(9000, "y" * 100)] * 200 + [(9001, "z" * 5000), (None, None), (5, None)]
    out = sharding.shard(docs(rows), limit=2000).collect()
    assert sorted(((r.doc_id is None, r.doc_id or 0), r.text or "") for r in out) == sorted(((k is None, k or 0), t or "") for k, t in rows)
    total = Counter()
    for r in out:
        assert r["__bytes"] == len(r.text or "")
        total[r["__depth"], r["__prefix"], r["__page"]] += r["__bytes"]
    for r in out:
        n = total[r["__depth"], r["__prefix"], r["__page"]]
        assert n == r["__shard_bytes"] and (n <= 2000 or r["__bytes"] > 2000)
    keys = {(d, p) for d, p, _ in total}                          # prefix-free: no shard is the start of another
    assert not any(d < e and q >> (e - d) == p for d, p in keys for e, q in keys)
    # Only what had to be split was: a shard and its sibling don't fit one together.
    assert sharding.shard(docs([]), 10).count() == 0 and sharding.shard(docs(["a"]), 10).collect()[0]["__depth"] == 0


def test_decontamination_finds_reworded_slots_and_leaves_the_rest(spark, docs, prose):
    items = [(1, "The train left Berlin at noon and then Anna bought 3 apples for 12 dollars while Anna waited near the old station."),
             (2, prose(40, 50)), (3, "short one"), (4, None), (None, prose(30, 51)), (5, prose(40, 50))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    same = items[0][1]
    changed = same.replace("Anna", "Maria").replace("Berlin", "Paris").replace("12 dollars", "450 euros").replace(" 3 ", " 17 ")
    mixed_up = same.replace("then Anna", "then Maria")            # one name, two values: still one of several slots
    texts = [same, "intro words here. " + changed + " and after that", prose(60, 1), prose(20, 2) + " " + prose(40, 50).upper().lower() + " " + prose(20, 3),
             "", None, "short one", prose(50, 4) + " " + " ".join(prose(40, 50).split()[:8]), mixed_up]
    got = decontaminate.leaks(docs(texts), bench).collect()
    assert {(r.doc_id, r.item_id) for r in got if r.doc_id != 8} == {(0, 1), (1, 1), (3, 2), (3, 5), (6, 3)}
    kept = decontaminate.clean(docs(texts + [texts[2]]), bench)
    assert {2, 4, 5, 7} <= {r.doc_id for r in kept.collect()} and kept.columns == docs([]).columns
    assert decontaminate.leaks(docs([]), bench).count() == 0 and decontaminate.leaks(docs(texts), bench.limit(0)).count() == 0


def test_plans_do_not_repeat_earlier_steps(spark, docs):
    items = ["Compute 48 / 6 + 7 * 2 - 5 + 9", TRAIN, "How many balls?"]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    kept = decontaminate.clean(docs([f"First. {t} And on." for t in items] + ["nothing here"]), bench)
    plan = kept._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("HashAggregate") == 0 and plan.count("Join") == 1      # the driver holds and replans what a plan repeats
    assert {r.doc_id for r in kept.collect()} == {3}


def test_slot_consistency(spark, docs):
    text = "then {0} gave seven things to {1} because {0} liked {1} more than {0} liked the others there"
    bench = spark.createDataFrame([(1, "So " + text.format("Anna", "Boris"))], "item_id long, text string")
    good, bad = "So " + text.format("Maria", "Piotr"), "So then Maria gave seven things to Piotr because Olga liked Ivan more than Petra liked the others there"
    assert {r.doc_id for r in decontaminate.leaks(docs([good, bad]), bench).collect()} == {0}


BALLS = ("There are 3 red balls in the first box. There are 5 red balls in the second box. There are 7 red balls in the third box. "
         "How many balls are there in total?")
TRAIN = "A train travels 120 km in 3 hours and then stops at the old station for 15 minutes before it goes on towards the sea"


def test_copies_with_repeated_windows_and_variants_are_found(spark, docs):
    bench = spark.createDataFrame([(1, BALLS), (2, TRAIN)], "item_id long, text string")
    variant = TRAIN.replace("120", "90").replace(" 3 ", " 2 ").replace("15", "25")
    cut = TRAIN.replace("old station", "old and rather small station")
    mixed = BALLS.replace("There are 5", "There were 5")
    texts = [BALLS, TRAIN + ". " + variant, variant + ". " + cut, "Some words here. " + mixed, cut, "There are 3 red balls in the bag and no more"]
    got = {(r.doc_id, r.item_id): r for r in decontaminate.leaks(docs(texts), bench).collect()}
    assert set(got) == {(0, 1), (1, 2), (2, 2), (3, 1), (4, 2)}
    assert got[0, 1].windows == got[0, 1].of and got[0, 1].slots == got[0, 1].agree == 3
    # Two copies with words put in, of different values: only a chain covers half of the item.
    words = TRAIN.split()
    apart = lambda t: " ".join(w + (" quite" if i in (8, 16) else "") for i, w in enumerate(t.split()))
    assert len(words) > 20
    assert {r.doc_id for r in decontaminate.leaks(docs([apart(TRAIN) + ". " + apart(variant)]), bench).collect()} == {0}


def test_items_of_numbers_are_found_verbatim(spark, docs):
    items = ["Compute 48 / 6 + 7 * 2 - 5 + 9", "12 + 7 * 3 - 4 = 29"]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    texts = [items[0], "First " + items[1].replace(" ", "  ") + " and on", items[0].replace("48", "36"), "12 + 7 * 3 - 4 = 30", "12 + 7 * 3", None, "nothing here",
             items[0] + ". " + items[0] + ". " + items[1]]
    got = decontaminate.leaks(docs(texts + [(0, items[0])]), bench)
    rows = {(r.doc_id, r.item_id): r for r in got.collect()}
    assert set(rows) == {(0, 0), (1, 1), (7, 0), (7, 1)} and got.count() == 4
    assert all(r.windows == r.of and r.slots == r.agree > 0 for r in rows.values())
    assert {r.doc_id for r in decontaminate.clean(docs(texts), bench).collect()} == {2, 3, 4, 5, 6}


def test_one_kept_window_is_no_leak(spark, docs):
    items = ["What is 3 + 4 * 5 - 6 + 7 * 8 - 9", "take the a b 1 2 3 4 5 6 7 8 9 10 11 12"]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    texts = ["Nobody knows what is 12, 15, 18 in this old list of house numbers", items[0], "so take the a b 5 6 7 from here", "and " + items[1] + " here"]
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs(texts), bench).collect()} == {(1, 0), (3, 1)}


def test_short_items_match_texts_and_sentences(spark, docs):
    items = [(1, "What is 2 + 2?"), (2, "Yes"), (3, "Yes"), (4, "?!"), (5, "name the capital"), (5, BALLS), (6, "What is 2 + 3?")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    texts = ["what is 2 + 2", "First of all. What is 2 + 2? That was easy.", "Know what is 2 + 2 for", "yes!", "Yes. No. Yes.", "one\nName the capital\r\ntwo", BALLS, "", None,
             "?!", "What is 2 + 3?", "Name the capital. " + BALLS]
    got = decontaminate.leaks(docs(texts + [(0, texts[0])]), bench).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(0, 1), (1, 1), (3, 2), (3, 3), (5, 5), (6, 5), (10, 6), (11, 5)]
    assert all(r.windows == r.of for r in got)
    assert {r.doc_id for r in decontaminate.clean(docs(texts), bench).collect()} == {2, 4, 7, 8, 9}


def held(tok, item, cover=decontaminate.COVER, n=decontaminate.WORDS):
    """Every item against every text in plain Python; tokens as `_tokens` gives them."""
    kind = lambda x: x[0] if x < "\u0005" else x
    wins = lambda t: [tuple(map(kind, t[i:i + n])) for i in range(len(t) - n + 1)]
    few = lambda w: sum(x < "\u0005" for x in w) <= decontaminate.MOST_PLACEHOLDERS
    mine, theirs = wins(item), wins(tok)
    if not mine:
        return bool(item) and tok == item
    good = {w for w in mine if few(w)}
    if len(good) < cover * len(set(mine)) or sum(map(few, mine)) < cover * len(mine):
        return any(tok[i:i + len(item)] == item for i in range(len(tok)))
    at = [(p, q) for p, w in enumerate(theirs) if w in good for q, v in enumerate(mine) if v == w]
    shifts = Counter(p - q for p, q in at)
    ways = [at] + [[x for x in at if x[0] - x[1] == s] for s in shifts]
    chains, last = [], None
    for p in sorted({p for p, _ in at}):
        q = min((-shifts[p - q], p - q, q) for a, q in at if a == p)[2]
        if last is None or q <= last:
            chains.append([])
        chains[-1].append((p, q))
        last = q
    for way in ways + chains:
        seen = {}
        for p, q in way:
            for j in range(n):
                if item[q + j] < "\u0005":
                    seen.setdefault(item[q + j], set()).add(tok[p + j])
        agree = sum(len(v) == 1 for v in seen.values())
        if len({mine[q] for _, q in way}) >= cover * len(set(mine)) and agree >= decontaminate.CONSISTENT * len(seen):
            return True
    return False


def test_leaks_are_those_of_brute_force(spark, docs):
    rnd = random.Random(8)
    word = lambda: rnd.choice(["so", "the", "cat", "sat", "on", "mat", "Anna", "Boris", "3", "7", "12 km", "9 kg", "5", "and", "saw"])
    items = [" ".join(word() for _ in range(rnd.choice([2, 4, 6, 9, 14, 20]))) for _ in range(40)]
    texts = []
    for i in range(120):
        t = rnd.choice(items).split()
        for _ in range(rnd.choice([0, 0, 1, 2, 4])):                # words changed, put in or left out
            k = rnd.randrange(len(t))
            t[k:k + 1] = rnd.choice([[], [word()], [t[k], word()]])
            t = t or ["so"]
        texts.append(" ".join([word() for _ in range(rnd.choice([0, 0, 3]))] + t + (rnd.choice(items).split() if i % 4 == 0 else [])))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    tokens = lambda df, k: {r[0]: r[1] for r in df.select(k, decontaminate._tokens(F.col("text"))).collect()}
    d, b = tokens(docs(texts), "doc_id"), tokens(bench, "item_id")
    want = {(i, j) for i, t in d.items() for j, x in b.items() if held(t, x)}
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs(texts), bench).collect()} == want and len(want) > 50


def test_windows_joined_by_shuffle_give_the_same(spark, docs, prose, monkeypatch):
    bench = spark.createDataFrame([(i, prose(30, i)) for i in range(20)], "item_id long, text string")
    texts = [prose(20, 100 + i) + " " + prose(30, i % 25) for i in range(50)]
    key = lambda: sorted((r.doc_id, r.item_id) for r in decontaminate.leaks(docs(texts), bench).collect())
    want = key()
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", 0)
    assert key() == want and len(want) == 40
    assert F is not None
