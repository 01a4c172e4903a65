import random

import pytest

from lodestone.llm import decontam

ITEM = "A train leaves the old station at 9 and travels 120 km toward Boston while Alice counts 14 red birds near the quiet river"
OTHER = "She sold several baskets of fresh fruit to hungry sailors before the market closed for the long rainy winter season"


def run(spark, docs, items):
    d = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, item_id int")
    b = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, doc_id int")
    return {(r.doc_id, r.item_id): r for r in decontam.contaminated(d, b).collect()}


def test_exact_reparameterised_and_clean(spark):
    pad = "Some other words come first. " * 20
    docs = [
        (1, pad + ITEM + " " + pad), (2, ITEM.upper().replace("BOSTON", "Boston").replace("ALICE", "Alice")),
        (3, ITEM.replace("9", "10").replace("120", "75").replace("14", "6").replace("Boston", "Denver").replace("Alice", "Maria")),
        (4, OTHER), (5, pad * 30), (6, None), (7, ""), (None, ITEM), (8, " ".join(ITEM.split()[:9])), (9, ITEM + "\n" + OTHER), (9, ITEM + "\n" + OTHER),
    ]
    got = run(spark, docs, [(1, ITEM), (2, OTHER), (3, None), (4, "too short"), (5, "")])
    assert set(got) == {(1, 1), (2, 1), (3, 1), (4, 2), (9, 1), (9, 2)}
    assert got[3, 1].reparameterised and not got[1, 1].reparameterised
    assert got[1, 1].coverage == 1.0


def test_slots_must_be_consistent(spark):
    item = "There are 5 boxes and 5 lids and 5 bags and 5 cups on the shelf in here"
    same = item.replace("5", "8")
    mixed = "There are 1 boxes and 2 lids and 3 bags and 4 cups on the shelf in here"
    assert set(run(spark, [(1, same), (2, mixed)], [(1, item)])) == {(1, 1)}


def test_windows_of_placeholders_alone_need_equal_values(spark):
    assert set(run(spark, [(1, "1 2 3 4 5 6 7 8"), (2, "9 8 7 6 5 4 3 2")], [(1, "1 2 3 4 5 6 7 8")])) == {(1, 1)}


def test_names_at_sentence_starts_and_copies_in_other_cases(spark):
    item = "Tom has 3 apples in a basket. Tom buys 4 more apples at the market. How many apples does Tom have now"
    docs = [(1, item.replace("Tom", "Ann").replace("3", "5").replace("4", "9")), (2, ITEM.lower()), (3, ITEM.upper()), (4, item.lower()), (5, item.upper())]
    assert set(run(spark, docs, [(1, item), (2, ITEM)])) == {(1, 1), (2, 2), (3, 2), (4, 1), (5, 1)}


def test_questions_dense_with_slots(spark):
    item = "If 3 kg cost 6 dollars what do 5 kg cost"
    docs = [(1, "If 4 kg cost 8 dollars what do 7 kg cost"), (2, "If 4 kg cost 8 dollars what do 4 kg cost"), (3, "rows 3 kg 6 dollars 5 kg 3 kg 6 dollars 5 kg 1 2 3 4 5 6 7")]
    got = run(spark, docs, [(1, item)])
    assert set(got) == {(1, 1), (2, 1)} and got[1, 1].reparameterised


def test_numbers_in_words_of_any_length(spark):
    item = "A farmer sells twenty five sheep at the spring market and keeps three hundred and six others on the hill"
    docs = [(1, item.replace("twenty five", "forty")), (2, item.replace("twenty five", "two hundred")), (3, item.replace("twenty five", "25"))]
    got = run(spark, docs, [(1, item)])
    assert set(got) == {(1, 1), (2, 1), (3, 1)} and all(r.coverage == 1.0 for r in got.values())


def test_alignments_that_contradict_each_other_do_not_add_up(spark):
    item = "There are 5 boxes in the hall and there we see other boxes; later 5 lids lie upon the floor near a door that stands open to the garden"
    half = item.split("; ")
    one = "There are 7 boxes in the hall and there we see other boxes"
    two = "later 9 lids lie upon the floor near a door that stands open to the garden"
    agree = "later 7 lids lie upon the floor near a door that stands open to the garden"
    docs = [(1, f"{one} quite {two}"), (2, f"{one} quite {agree}"), (3, f"{half[0]} quite {half[1]}"), (4, agree + " word " * 300 + one)]
    assert set(run(spark, docs, [(1, item)])) == {(2, 1), (3, 1)}


def test_short_items_are_whole_sentences(spark):
    docs = [(1, "We read. Name 3 rivers. Then go"), (2, "Name 4 rivers."), (3, "please Name 3 rivers. Now"), (4, "x\nname 3 rivers\ny"), (5, "Name 3 rivers and lakes"), (6, "too")]
    assert set(run(spark, docs, [(1, "Name 3 rivers."), (2, ""), (3, "too")])) == {(1, 1), (4, 1), (6, 3)}


def brute(doc, item, coverage):
    """Coverage by single alignments over plain template words, all places tried."""
    codes = decontam._Codes()
    c, p, *_, dv = decontam.template(doc, codes)
    ic, ip, *_, iv = decontam.template(item, codes)
    n = len(ic) - 4
    best = 0
    for shift in range(-len(ic), len(c)):
        hit, pairs, lits, anchor = set(), set(), set(), False
        for i in range(n):
            j = i + shift
            if 0 <= j <= len(c) - 5:
                for x, y in ((ic, c), (ip, p)):
                    if (x[i : i + 5] == y[j : j + 5]).all():
                        slot = [k for k in range(5) if x[i + k] < 8]
                        values = {(iv(i + k), dv(j + k)) for k in slot}
                        hit.add(i)
                        pairs |= values
                        lits |= {i + k for k in range(5) if k not in slot}
                        anchor |= len(slot) <= 3 or all(a == b for a, b in values)
        if hit and anchor and len(pairs) == len({a for a, _ in pairs}) and (len(lits) >= 3 or all(a == b for a, b in pairs)):
            best = max(best, len(hit))
    return best >= coverage * n


def test_single_alignments_against_brute_force(spark):
    rng = random.Random(2)
    some = ["the", "cat", "sat", "Bob", "Eve", "3", "7", "km", "kg", "red", "on", "a"]
    items = [(i, " ".join(rng.choices(some, k=rng.randint(5, 14)))) for i in range(25)]
    docs = []
    for d in range(120):
        words = rng.choice(items)[1].split()
        for at in range(len(words)):
            if rng.random() < 0.08:
                words[at] = rng.choice(some)
        swap = dict(zip(["3", "7"], rng.sample(["3", "7", "9"], 2), strict=True)) if rng.random() < 0.5 else {}
        docs.append((d, " ".join(rng.choices(some, k=rng.randint(0, 6)) + [swap.get(w, w) for w in words] + rng.choices(some, k=rng.randint(0, 6)))))
    got = set(run(spark, docs, items))
    wanted = {(d, i) for d, t in docs for i, x in items if brute(t, x, 0.8)}
    assert len(wanted) > 60 and wanted <= got and len(got - wanted) <= 0.1 * len(wanted)  # more: neighbouring alignments together


@pytest.mark.parametrize("docs", [[], [(1, ITEM)]])
def test_empty_tables(spark, docs):
    assert run(spark, docs, []) == {}
    assert run(spark, [], [(1, ITEM)]) == {}


def test_all_planted_items_are_found(spark):
    d = "/root/testdata/sf0.01"
    docs, items = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/benchmark.parquet")
    texts = {r.doc_id: " ".join(r.text.split()) for r in docs.collect()}
    wanted = {(i, b.item_id) for b in items.collect() for i, t in texts.items() if " ".join(b.text.split()) in t}
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(docs, items).collect()}
    assert wanted and wanted <= got and len(got) < len(wanted) + 5


def test_very_long_texts_and_extra_columns(spark):
    rng = random.Random(5)
    words = [f"w{rng.randrange(50)}" for _ in range(400_000)]
    text = " ".join(words[:200_000]) + " " + ITEM + " " + " ".join(words[200_000:]) + " one two three" * 100_000
    d = spark.createDataFrame([(1, text, "x", 5, "y"), (2, "nine " * 300_000, "x", 5, "y")], "doc_id long, text string, h string, pos int, key string")
    b = spark.createDataFrame([(1, ITEM, 3, "z")], "item_id long, text string, n int, slots string")
    assert {(r.doc_id, r.item_id) for r in decontam.contaminated(d, b).collect()} == {(1, 1)}
