"""Rules, substring dedup, n-gram join, decontamination and language identification against brute force."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from voxtable.llm import components, decontamination, kernel, language_id, ngram_join, quality_rules, substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab é\n\t\x0b\x1f漢#", max_size=30)), max_size=12))
def test_words_of_the_kernel(texts):
    data, offsets = kernel.text_arrays(pa.array(texts, pa.string()))
    found, hashes = [], {}
    for a, b in kernel.blocks(offsets, 20):
        w = kernel.Words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        spans = [bytes(w.data[x:y]).decode() for x, y in zip(w.starts, w.ends)]
        found += [spans[x:y] for x, y in zip(w.first, w.first[1:])]
        for s, h in zip(spans, w.hashes().tolist()):
            assert hashes.setdefault(s, h) == h
    assert found == [words(t) for t in texts]
    assert len(set(hashes.values())) == len(hashes)


def rules_of(text: str | None) -> tuple:
    w, t = words(text), text or ""
    windows = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    covered = {i for k in range(len(w) - 4) if windows[tuple(w[k : k + 5])] > 1 for i in range(k, k + 5)}
    lines = [x for x in t.split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines), len(lines) - len(set(lines)), len(covered)


def test_quality_measures(docs, rows):
    got = quality_rules.ledger(docs, keep=("bucket",)).collect()
    assert Counter((r.doc_id, *(r[m] for m in quality_rules.MEASURES)) for r in got) == Counter((r[0], *rules_of(r[1])) for r in rows)


def test_quality_policies_and_ablation(docs, empty):
    led = quality_rules.ledger(docs)
    kept = {p: quality_rules.apply_policy(led, p).where("kept").count() for p in quality_rules.POLICIES}
    assert kept["base-1"] >= kept["web-1"] >= kept["web-2"] > 0
    assert quality_rules.passing(docs).count() == kept[quality_rules.CURRENT]
    assert quality_rules.passing(docs).schema == docs.schema
    for r in quality_rules.ablation(led).collect():
        rest = tuple(x for x in quality_rules.RULES if x != r.rule)
        assert r.n_kept_without == led.where(~quality_rules.fails(rest)).count()
    assert quality_rules.ledger(empty).count() == quality_rules.passing(empty).count() == 0


def test_quality_ledger_with_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b c " * 9, 5, "x"), (2, "one two", 6, "y")], "doc_id long, text string, n_words int, Fail_bits string")
    got = {r.doc_id: r for r in quality_rules.ledger(docs, keep=("n_words", "text", "Fail_bits", "doc_id")).collect()}
    assert [(got[k].n_words, got[k].n_words_, got[k].Fail_bits_, got[k].text) for k in (1, 2)] == [(27, 5, "x", "a b c " * 9), (2, 6, "y", "one two")]
    assert quality_rules.passing(docs, policy=("long_words",)).collect() == docs.collect()
    assert quality_rules.passing(docs, policy=("few_words",)).collect() == docs.where("doc_id = 1").collect()


def dedup_of(rows: list[tuple], n: int) -> Counter:
    least = defaultdict(lambda: float("inf"))
    for r in rows:
        w = words(r[1])
        for k in range(len(w) - n + 1):
            if r[0] is not None:
                least[tuple(w[k : k + n])] = min(least[tuple(w[k : k + n])], r[0])
    out = Counter()
    for r in rows:
        w, gone = words(r[1]), set()
        for k in range(len(w) - n + 1):
            if r[0] is not None and least[tuple(w[k : k + n])] < r[0]:
                gone |= set(range(k, k + n))
        left = " ".join(x for i, x in enumerate(w) if i not in gone)
        out[r[0], len(w), len(gone), hashlib.sha256(left.encode()).hexdigest()] += 1
    return out


@pytest.mark.parametrize("n", [13, 4])
def test_substring_dedup(docs, rows, n):
    got = substring_dedup.deduplicate(docs, window=n).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept.hex()) for r in got) == dedup_of(rows, n)
    assert all(sum(s["last"] - s["first"] + 1 for s in r.spans) == r.n_removed for r in got)
    assert any(r.n_removed for r in got)


def test_substring_dedup_in_two_steps(docs, rows, monkeypatch):
    """More buckets than one task deals out at once: packets go by ranges of buckets first."""
    monkeypatch.setattr(substring_dedup, "GROUP_BYTES", 3000)
    monkeypatch.setattr(substring_dedup, "FAN", 3)
    monkeypatch.setattr(substring_dedup, "SEND_WORDS", 700)
    got = substring_dedup.deduplicate(docs, window=5).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept.hex()) for r in got) == dedup_of(rows, 5)


def test_substring_dedup_of_one_id(spark):
    """Very many rows of one id, with the same and other texts, are one document and lie in several groups."""
    text = " ".join(f"x{k}" for k in range(20))
    rows = [(7, text if k % 2 else f"{text} y{k}") for k in range(60)] + [(5, text), (9, text), (None, text)]
    got = substring_dedup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept.hex()) for r in got) == dedup_of(rows, 13)


def test_substring_dedup_texts(docs, rows, empty):
    got = substring_dedup.deduplicate(docs, keep_text=True, carry=("text", "grp")).collect()
    assert Counter((r.doc_id, r.carry0, r.carry1) for r in got) == Counter((r[0], r[1], r[6]) for r in rows)
    for r in got:
        assert (r.kept is None) == (r.carry0 is None)
        gone = {i for s in r.spans for i in range(s["first"], s["last"] + 1)}
        assert words((r.kept or b"").decode()) == [x for i, x in enumerate(words(r.carry0)) if i not in gone]
        assert r.n_removed or r.kept is None or r.kept.decode() == r.carry0
    assert substring_dedup.deduplicate(empty).count() == 0


def links_of(rows: list[tuple], k: int, num: int, den: int) -> Counter:
    def fold(t):
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")

    sets = []
    for r in rows:
        w = words(fold(r[1]))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    names = {i: r[0] for i, r in enumerate(rows)}
    group = list(range(len(rows)))

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if names[i] is None or names[j] is None:
                continue
            if names[i] == names[j] or a and b and den * len(a & b) >= num * len(a | b):
                group[find(i)] = find(j)
    least = {}
    for i in range(len(rows)):
        if names[i] is not None:
            least[find(i)] = min(least.get(find(i), names[i]), names[i])
    return Counter((r[0], len(sets[i]), least[find(i)] if r[0] is not None else None) for i, r in enumerate(rows))


@pytest.mark.parametrize(("k", "num", "frequent"), [(3, 90, 1 << 16), (5, 80, 2), (1, 60, 1 << 16)])
def test_ngram_join(docs, rows, k, num, frequent, monkeypatch):
    monkeypatch.setattr(ngram_join, "FREQUENT", frequent)
    got = ngram_join.link_components(docs, shingle=k, num=num, den=100).collect()
    want = links_of(rows, k, num, 100)
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == want
    assert len({c for _, _, c in want}) < len(want)


def hot_rows() -> list[tuple]:
    """A third of the rows are copies of one text, a third near copies of it, and all share a passage."""
    rng = np.random.default_rng(6)
    pick = lambda n: [f"h{i}" for i in rng.integers(0, 5000, n)]
    passage, copied = pick(6), pick(60)
    rows = [(3 * k, " ".join(passage + copied)) for k in range(70)]
    rows += [(3 * k + 1, " ".join([*passage, *copied[:k], "other", *copied[k + 1 :]])) for k in range(60)]
    return rows + [(3 * k + 2, " ".join(pick(30) + passage + pick(int(rng.integers(0, 40))))) for k in range(70)]


@pytest.mark.parametrize(("k", "num"), [(3, 90), (5, 80)])
def test_ngram_join_of_a_hot_group(spark, k, num, monkeypatch):
    """The common tokens are dealt out by salt."""
    monkeypatch.setattr(ngram_join, "FREQUENT", 50)
    rows = hot_rows()
    got = ngram_join.link_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(7), shingle=k, num=num, den=100).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == links_of(rows, k, num, 100)


def test_substring_dedup_of_a_hot_group(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "GROUP_BYTES", 2000)
    rows = hot_rows()
    got = substring_dedup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept.hex()) for r in got) == dedup_of(rows, 13)


@pytest.mark.parametrize("name", ["FAN", "ADDED"])
def test_ngram_join_in_several_steps(docs, rows, name, monkeypatch):
    """Buckets dealt out in two steps, and sketches added up in a tree."""
    monkeypatch.setattr(ngram_join, name, 1 if name == "FAN" else 2)
    monkeypatch.setattr(ngram_join, "BUCKET_BYTES", 4096)
    got = ngram_join.link_components(docs, shingle=3, num=80).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == links_of(rows, 3, 80, 100)


def test_ngram_join_of_ids_with_several_texts(spark):
    a, b, c, d = ("one two three four", "five six seven eight", "nine ten eleven twelve", "red green blue black")
    rows = [(5, a), (3, a), (5, b), (7, b), (9, c), (8, d), (8, c), (8, ""), (2, None), (None, a), (6, d)]
    got = ngram_join.link_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == links_of(rows, 3, 90, 100)
    assert {r.component_id for r in got if r.doc_id in (3, 5, 7)} == {3} and {r.component_id for r in got if r.doc_id in (6, 8, 9)} == {6}


def test_histograms_bound_intersections():
    rng = np.random.default_rng(1)
    for n in (3, 400, 30_000):
        p = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        q = np.unique(np.concatenate([p[: n // 2], rng.integers(0, 2**63, n // 2).astype(np.uint64)]))
        cells = [ngram_join.cells_of(ngram_join.histograms(np.zeros(len(x), np.int64), x, 1)) for x in (p, q)]
        assert [int(c.sum()) for c in cells] == [len(p), len(q)]
        assert np.minimum(*cells).sum() >= len(np.intersect1d(p, q))


def test_ngram_join_of_nothing(empty):
    assert ngram_join.link_components(empty).count() == 0


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(10, 60)] + [(100, 101), (103, 101), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in components.components(edges).collect()}
    assert got == {i: 10 for i in range(10, 61)} | {100: 100, 101: 100, 103: 100}


ITEM = "The quick brown fox Anna Smith ran 12 km in 3.5 hours and then sold 40 apples for the price of one large melon today."


def test_decontamination(spark, empty):
    other = ITEM.replace("12", "77").replace("Anna", "Berta").replace("3.5", "9").replace("40", "8")
    mixed = "gave 3 apples to Tom and then 3 pears to Tom because nothing"
    bench = spark.createDataFrame([(1, ITEM), (1, ITEM), (2, mixed), (3, None), (4, "One two three"), (5, "seven tokens make a short item here")], "item_id long, text string")
    noise = " ".join(f"x{i}" for i in range(30))
    texts = {
        10: f"{noise} {ITEM} {noise}", 11: f"{noise} {other.upper().lower()} {noise}", 12: f"{noise}. {other}", 13: noise, 14: None, 15: "",
        16: mixed.replace("3 apples", "5 apples").replace("3 pears", "5 pears"), 17: mixed.replace("3 apples", "5 apples").replace("3 pears", "6 pears"), 18: "(seven) tokens: make a short item, here!", 19: ITEM.upper(),
    }
    docs = spark.createDataFrame([(k, v, "s") for k, v in texts.items()], "doc_id long, text string, item_id string")
    got = {(r.doc_id, r.item_id): r for r in decontamination.contaminated(docs, bench).collect()}
    assert {k for k in got if k[0] != 11} == {(10, 1), (12, 1), (16, 2), (18, 5), (19, 1)}
    assert got[10, 1].n_exact == got[10, 1].n_windows > 0 and got[12, 1].n_exact < got[12, 1].n_windows
    assert got[10, 1].first_word == 30
    assert decontamination.contaminated(empty, bench).count() == 0
    assert decontamination.contaminated(docs, bench.where("item_id < 0")).count() == 0


def found(spark, items: dict[int, str], texts: dict[int, str]) -> set[tuple[int, int]]:
    """(doc_id, item_id) of the contaminated pairs."""
    table = lambda x, name: spark.createDataFrame(list(x.items()), f"{name} long, text string")
    pairs = {(r.doc_id, r.item_id) for r in decontamination.contaminated(table(texts, "doc_id"), table(items, "item_id")).collect()}
    ids = [r.doc_id for r in decontamination.contaminated_ids(table(texts, "doc_id"), table(items, "item_id")).collect()]
    assert sorted(ids) == sorted({d for d, _ in pairs})
    return pairs


def test_decontamination_of_verbatim_copies(spark):
    """An item of numbers, units or few tokens is found where it is copied, and only there."""
    items = {1: "Compute 12 + 34 * 56 - 78 / 9 = ?", 2: " ".join(map(str, range(3, 90, 4))), 3: "5 km 7 kg 9 hours 2 cm 8 miles", 4: "Name Zorbl's capital", 5: "?!", 6: "Anna Berta Carl 3"}
    texts = {10 + i: f"before it, {text} and after" for i, text in items.items()} | {20: "Compute 12 + 34 * 57 - 78 / 9 = ?", 21: items[3].replace("7", "6"), 22: "Name Zorbl's king", 23: "anna berta carl 4"}
    assert found(spark, items, texts) == {(10 + i, i) for i in items if i != 5}


def test_decontamination_of_names_that_start_sentences(spark):
    items = {1: "Anna buys 12 apples. Berta buys 7 more. Carl eats 5. How many are left?", 2: "Anna has 3 plums. Berta has 4. Total?", 3: "Paul walks to the old red barn each day."}
    texts = {
        10: "noise Dora buys 9 apples. Emil buys 8 more. Fritz eats 2. How many are left?", 11: "Dora has 5 plums. Emil has 7. Total?", 12: "we saw that Karl walks to the old red barn each day.",
        13: "Dora buys 9 apples. Emil sells 8 more. Dora eats 2. How much is left?", 14: "Dora has 5 plums. Emil has 7. Difference?", 15: "Dora Has 5 Plums. Emil Has 7. Some?", 16: ITEM.upper().lower().replace("anna", "berta"),
    }
    assert found(spark, items | {4: ITEM}, texts) == {(10, 1), (11, 2), (12, 3), (16, 4)}


def test_decontamination_of_values_that_become_equal(spark):
    """Equal values of the item stay equal; different ones may become so, and a unit may change its form."""
    items = {1: "she bought 3 apples and 5 pears at the shop today", 2: "it took 2 hours there and then 3 hours back", 3: "gave 3 apples and then 3 pears to my friend"}
    texts = {10: items[1].replace("3", "4").replace("5", "4"), 11: items[2].replace("2 hours", "1 hour"), 12: items[2].replace("3 hours", "50 minutes"), 13: items[3].replace("3 apples", "4 apples"), 14: items[3].replace("3", "8")}
    assert found(spark, items, texts) == {(10, 1), (11, 2), (14, 3)}


TOKEN = re.compile(r"[0-9A-Za-z\x80-\U0010ffff]+(?:[^\x20\x09-\x0D]*[0-9A-Za-z\x80-\U0010ffff]+)?")


def slow_forms(text: str) -> list[list[tuple[str, str, str]]]:
    """(type or "", what the template has, the value) of each token, in the four forms, token by token."""
    out, kinds, plain = [], [], []
    before_number, starts = False, True
    for word in words(text):
        found = TOKEN.search(word)
        core = found[0] if found else ""
        if core:
            digits, letters = sum(c.isdigit() for c in core), sum(c.isalpha() for c in core)
            number = digits > 0 and (letters == 0 or core[0].isdigit() and letters <= 4)
            upper = core[0].isupper()
            kind = "number" if number else "unit" if before_number and core.lower() in decontamination.UNITS else "name" if upper and not starts else ""
            kinds.append((kind, upper))
            plain.append(core.lower())
            before_number = number
        starts = word[-1] in ".!?:"
    for form in range(4):
        row = []
        for (kind, upper), value in zip(kinds, plain, strict=True):
            spelt = "" if kind == "name" else kind
            shown = (kind, spelt, "", "name" if spelt == "" and upper else spelt)[form]
            row.append((shown, f"<{shown}>" if shown else value, value))
        out.append(row)
    return out


def slow_windows(text: str, k: int) -> list[tuple]:
    """(form, template, slots) of the windows of k tokens."""
    forms, out = slow_forms(text), []
    count = lambda window, test: sum(map(test, window))
    for at in range(len(forms[0]) - k + 1):
        base, spelt, _, capitals = (f[at : at + k] for f in forms)
        literal = [count(w, lambda x: not x[0]) for w in (base, spelt, spelt, capitals)]
        values = count(spelt, lambda x: bool(x[0]))
        use = [k >= 5 and 2 * literal[0] >= k, k >= 5 and 2 * literal[1] >= k and any(x[0] == "name" for x in base), k < 5 or values > 0]
        use.append(k >= 5 and 4 * literal[3] >= k and 2 * (k - values) >= k and (any(a[0] != b[0] for a, b in zip(base, capitals)) or 2 * literal[0] < k))
        out += [(form, " ".join(x[1] for x in forms[form][at : at + k]), [(x[0], x[2]) for x in forms[form][at : at + k] if x[0]]) for form in range(4) if use[form]]
    return out


def slow_contaminated(items: dict[int, str], texts: dict[int, str]) -> set[tuple[int, int]]:
    found = set()
    for i, item in items.items():
        n = len(slow_forms(item)[0])
        k = min(n, decontamination.WINDOW)
        for d, text in texts.items() if k else ():
            for _, template, slots in slow_windows(text, k):
                for _, other, given in slow_windows(item, k):
                    if template != other or [t for t, _ in slots] != [t for t, _ in given]:
                        continue
                    one = lambda v: [(t, decontamination.UNITS[x] if t == "unit" else x) for t, x in v]
                    pairs = list(zip(one(given), one(slots)))
                    equal = sum(a == b and a[0] == "name" for a, b in pairs)
                    if len(set(pairs)) == len({a for a, _ in pairs}) and 2 * (k - len(given) + equal) >= k:
                        found.add((d, i))
    return found


def test_decontamination_of_slots_against_brute_force(spark):
    """Numbers, names, units, sentence starts and short items, with slots changed at random."""
    rng = np.random.default_rng(8)
    words_ = ["buys", "sells", "the", "apples", "walks", "and", "then", "to", "red", "old"]
    pick = lambda x: x[int(rng.integers(0, len(x)))]

    def make(n):
        out = []
        while len(out) < n:
            out += pick([[pick(words_)], [pick(words_)], [pick(["Anna", "Bert", "Cleo"])], [str(rng.integers(1, 9)), pick(["km", "hours", "hour", "x"])], [pick(words_) + "."]])
        return out

    items, texts = {i: make(int(rng.integers(2, 19))) for i in range(14)}, {}
    for d in range(90):
        copy = [pick(["Anna", "Bert", "Cleo"]) if w in ("Anna", "Bert", "Cleo") and rng.random() < 0.4 else str(rng.integers(1, 9)) if w.isdigit() and rng.random() < 0.5 else w for w in items[d % 14]]
        texts[d] = make(int(rng.integers(0, 9))) + copy + make(int(rng.integers(0, 9)))
    items, texts = ({k: " ".join(v) for k, v in x.items()} for x in (items, texts))
    want = slow_contaminated(items, texts)
    assert found(spark, items, texts) == want and 20 < len(want) < 90 * 14 / 2


def test_decontamination_against_brute_force(spark):
    """Over lower-case words without numbers, templates are the words: pairs are those that share 13 in a row."""
    rng = np.random.default_rng(5)
    pick = lambda n: [f"v{chr(97 + i)}" for i in rng.integers(0, 6, n)]
    items = {i: pick(int(rng.integers(13, 30))) for i in range(12)}
    texts = {i: pick(int(rng.integers(0, 60))) for i in range(80)}
    for i in range(0, 80, 4):
        source = items[i % 12]
        at = int(rng.integers(0, len(source) - 12))
        texts[i][3:3] = source[at : at + int(rng.integers(11, 16))]
    grams = lambda w: {tuple(w[k : k + 13]) for k in range(len(w) - 12)}
    want = {(d, i) for d, t in texts.items() for i, w in items.items() if grams(t) & grams(w)}
    table = lambda x, name: spark.createDataFrame([(k, " ".join(v)) for k, v in x.items()], f"{name} long, text string")
    got = decontamination.contaminated(table(texts, "doc_id"), table(items, "item_id")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and want


def test_network_gradients():
    rng = np.random.default_rng(0)
    n = language_id.Network(["a", "b", "c"], hidden=4)
    n.w = {k: w.astype(np.float64) for k, w in n.w.items()}
    x, inside, target = rng.integers(0, 256, (6, 5)).astype(np.uint8), np.ones((6, 5), np.float32), np.array([0, 1, 2, 1, 0])
    inside[4:, 1] = 0
    _, g = n.gradients(x, inside, target)
    for k, w in n.w.items():
        at = tuple(rng.integers(0, s) for s in w.shape)
        at = (at[0], int(x[2, 3])) if k[0] == "e" else at
        old, step = w[at], 1e-3
        w[at] = old + step
        up = n.gradients(x, inside, target)[0]
        w[at] = old - step
        down = n.gradients(x, inside, target)[0]
        w[at] = old
        assert abs((up - down) / 2 / step - g[k][at]) < 1e-4


def test_language_id(spark, empty):
    rng = np.random.default_rng(2)
    parts = {"en": ["the", "ing", "th", "ow", "wh"], "fr": ["eau", "é", "oi", "que", "ç"]}
    rows = [(i, " ".join("".join(rng.choice(parts[lang], 2)) for _ in range(int(rng.integers(8, 40)))), lang, "zz") for i in range(300) for lang in [("en", "fr")[i % 2]]]
    rows += [(1000, None, "en", ""), (1001, "12 34 !", "en", ""), (None, "the whing thow", None, ""), (1002, "", None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string").repartition(3)
    network = language_id.fit(docs, texts=100)
    got = {r.doc_id: r for r in language_id.identify(docs, network).collect()}
    assert len(got) == len(rows)
    held = [(got[i].lang_pred, lang) for i, _, lang, _ in rows[:300] if got[i].held_out]
    assert len(held) > 40 and np.mean([a == b for a, b in held]) > 0.95
    assert all(got[k].lang_pred == "und" and got[k].score == 0 for k in (1000, 1001, 1002))
    assert got[None].lang_pred == "en" and not got[None].held_out
    assert all(0 <= r.score <= 1 for r in got.values())
    assert language_id.identify(empty, network).count() == 0
    none = language_id.fit(docs.where("lang is null"))
    assert none is None and {r.lang_pred for r in language_id.identify(docs, none).collect()} == {"und"}
