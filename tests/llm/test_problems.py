"""The numbered operators on small tables, against brute force, and on empty, null, repeated, long and odd input."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from yearloom.llm import leakage, mixing, neardup, packing, pairs, residue, truncation

WORDS = [f"w{i}" for i in range(900)]


def _text(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


# 1


RESIDUE = {
    "The bond of {{amount}} was forfeited.": "placeholder",
    "We met [INSERT NAME] there.": "placeholder",
    "On TK DATE OF FILING the court met.": "placeholder",
    "Only %(rate)s of us paid.": "placeholder",
    "Governor [Speaker] preferred to wait.": "placeholder",
    "Governor {{speaker}} preferred to wait.": "placeholder",
    "404 Not Found. The requested URL /doc/1/2 was not found on this server.": "error",
    "A heading\n\nPlease\nenable JavaScript to view this page.": "notice",
    "Lorem ipsum dolor sit amet, consectetur adipiscing elit.": "filler",
}
SOUND = [
    "The clerk wrote “[sic]” beside the word.",
    "[T]he statute, as quoted, reaches only the public quota.",
    "The form of deed [exhibit 584] left the name blank.",
    "The rate (net) fell to 24 percent <see table 563>, or $115 a ton.",
    "The pamphlet said “page not found” where the old map had been cut out.",
    "Forms that still read “insert name here” were held void.",
    "See 404 Tid. Rep. 689; accord, 500 Tid. Rep. 87.",
    "Telephone service was unavailable in Elkcrest County for 5 days.",
    "[Footnote 689 omitted.] Nothing in the Act explains why.",
    "The agency said that its filing portal would not open unless scripts were enabled in the browser.",
    "",
    "  \n ",
    None,
]


def test_residue_labels(spark):
    texts = [*RESIDUE, *SOUND]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)] * 2, "key long, text string, label string, n int")
    got = {}
    for r in residue.residue(df, "key", "text").collect():
        got.setdefault(r.id, set()).add(r.label)
    assert {texts[i] for i in got} == set(RESIDUE)
    assert all(RESIDUE[texts[i]] in labels for i, labels in got.items())


def test_residue_label_spreads_to_near_copies_only(spark):
    known = "Your browser does not support scripts, or they are turned off, so that the reader for this volume of the county archive can be used in the reading room only"
    near = "Your browser does not support the script, or they are turned off, so that the reader for this volume of the county archive can be used in the reading room only"
    far = "The committee heard the request of the county and the content of the letter was read"
    next_ = near.replace("county archive", "town archive")
    df = spark.createDataFrame([(1, known), (2, near), (3, far), (4, next_)], "id long, text string")
    got = {r.id: (r.label, r.hops) for r in residue.residue(df, "id", "text", {"notice": [known]}).collect()}
    assert got == {1: ("notice", 0), 2: ("notice", 1), 4: ("notice", got[4][1])} and got[4][1] >= 1


def test_lookup_of_rare_grams_loses_no_likeness():
    import numpy as np
    import pyarrow as pa

    rng = random.Random(4)
    letters = "abcdefghij klmnop qrs tuvw"
    norms = sorted({" ".join("".join(rng.choice(letters) for _ in range(rng.randrange(8, 60))).split()) for _ in range(60)})
    near = []
    for norm in norms:
        for _ in range(5):
            chars = list(norm)
            for _ in range(rng.randrange(3)):
                chars[rng.randrange(len(chars))] = rng.choice("xyz")
            near.append("".join(chars))
    batch = pa.RecordBatch.from_pydict({"id": list(range(len(near))), "text": near})
    kept = {(i, n) for b in residue._read(norms, False)(iter([batch])) for i, n in zip(b["id"].to_pylist(), b["norm"].to_pylist())}
    assert residue.rare_grams(norms, np.zeros(1 << 22, int))
    for i, text in enumerate(near):
        form = residue.plain(text)
        if any(len(residue.grams(form) & residue.grams(n)) >= 0.8 * len(residue.grams(form) | residue.grams(n)) for n in norms):
            assert (i, form) in kept


def test_residue_of_unstated_forms_is_found_by_likeness(spark):
    names = ["Ash", "Birch", "Cedar", "Elm", "Fir", "Hazel", "Larch", "Maple"]
    texts = [f"{n} Mill Company paid {slot} to the widow of the clerk." for n, slot in zip(names, ["{{amount}}", "${sum}", "[INSERT AMOUNT]", "%(rate)s", "#{amount}", "[____amount____]", "<amount>", "«amount»"])]
    texts += ["He left «amount» upon the hill at dawn.", "Skip to content - your session has expiredd", "The clerk wrote [sic] in the book of deeds.", "They read [sic] in every line of it."]
    found = {r.id: r for r in residue.residue(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), "id", "text").collect()}
    assert set(found) == set(range(10))
    assert [found[i].hops for i in range(10)] == [0, 0, 0, 0, 1, 1, 1, 1, 2, 1]


def test_spreading_finds_wordings_and_slots_on_given_tables(spark):
    import os

    if not os.path.isdir("/root/testdata/sf0.01"):
        pytest.skip("no test data")
    synth = spark.read.parquet("/root/testdata/sf0.01/synth.parquet")
    rows = residue.residue(synth, "synth_id", "text").collect()
    spread = {r.id for r in rows if r.hops > 0} - {r.id for r in rows if r.hops == 0}
    assert len({r.id for r in rows}) >= 160 and len(spread) >= 10


def test_residue_without_a_common_word(spark):
    texts = ["Aliquip duis amet commodo magna tempor cillum nulla duis aute.", "Please turn on js.", "test, test, test", "Please turn\non js.", "The court sat at noon."]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    assert {r.id: r.label for r in residue.residue(df, "id", "text").collect()} == {0: "filler", 1: "notice", 2: "filler", 3: "notice"}


def test_residue_of_nothing(spark):
    assert residue.residue(spark.createDataFrame([], "id long, text string"), "id", "text").count() == 0


# 2


def _jaccard(a, b):
    one, two = ({tuple(w[i : i + 3]) for i in range(len(w) - 2)} for w in (re.findall("[a-z0-9]+", t.lower()) for t in (a, b)))
    return len(one & two) / len(one | two)


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(5)
    texts = {}
    for g in range(25):
        base = [_text(rng, 20) for _ in range(8)]
        for k in range(4):
            parts = list(base)
            if k == 1:
                parts[2], parts[6] = parts[6], parts[2]
            words = " . ".join(parts).split(" ")
            for _ in range(6 * k):
                words[rng.randrange(len(words))] = rng.choice(WORDS)
            texts[len(texts)] = " ".join(words)
    texts[900], texts[901] = texts[0], texts[0]
    texts[902], texts[903] = "short", "short"
    texts[904] = _text(rng, 20000)
    texts[905] = texts[904] + " and one more word"
    rows = [(i, t, 0, "z") for i, t in texts.items()] + [(0, texts[0], 0, "z"), (998, None, 0, "z"), (997, "", 0, "z"), (None, texts[1], 0, "z")]
    df = spark.createDataFrame(rows, "key long, body string, fp int, id string")
    got = {(r.a, r.b) for r in neardup.near_duplicate_pairs(df, "key", "body").collect()}
    long = [i for i, t in texts.items() if len(t.split()) >= 100]
    want = {(a, b) for a in long for b in long if a < b and _jaccard(texts[a], texts[b]) >= 0.5}
    assert got <= want and len(got) >= 0.95 * len(want) and (0, 900) in got and (900, 901) in got and (904, 905) in got
    assert all(p in got for p in want if _jaccard(texts[p[0]], texts[p[1]]) >= 0.65)
    groups = {r.id: r.group_id for r in neardup.near_duplicate_groups(df, "key", "body").collect()}
    assert set(groups) == {x for p in got for x in p} and all(groups[a] == groups[b] for a, b in got)


def test_large_buckets_lose_no_pair(spark, monkeypatch):
    rng = random.Random(3)
    base = _text(rng, 120).split()
    rows = []
    for i in range(40):
        words = list(base)
        words[rng.randrange(120)] = f"x{i}"
        rows.append((i, " ".join(words)))
    df = neardup.fingerprinted(spark.createDataFrame(rows, "id long, text string"), "id", "text")
    whole = {tuple(r) for r in neardup.candidates(df).collect()}
    monkeypatch.setattr(neardup, "BLOCK", 8)
    assert neardup.common_keys(df).count() == 0 and neardup.common_keys(df, 1).count() > 0
    assert {tuple(r) for r in neardup.candidates(df, 1).collect()} == whole and len(whole) == 40 * 39 // 2


def test_pairs_near_the_threshold_are_found(spark):
    rng = random.Random(11)
    rows, want = [], set()
    for i in range(400):
        one = [f"v{rng.randrange(10**6)}" for _ in range(rng.randrange(110, 300))]
        edits = rng.uniform(0.08, 0.14)
        two = [f"v{rng.randrange(10**6)}" if rng.random() < edits else w for w in one]
        if i % 8 == 0:
            parts = [one[j : j + 11] for j in range(0, len(one), 11)]
            rng.shuffle(parts)
            two = [w for part in parts for w in part]
        x, y = ({tuple(w[j : j + 3]) for j in range(len(w) - 2)} for w in (one, two))
        if 0.5 <= len(x & y) / len(x | y) <= 0.75:
            want.add((2 * i, 2 * i + 1))
        rows += [(2 * i, " ".join(one)), (2 * i + 1, " ".join(two))]
    got = {tuple(r) for r in neardup.near_duplicate_pairs(spark.createDataFrame(rows, "id long, text string"), "id", "text").collect()}
    assert len(want) > 200 and len(want - got) <= 0.01 * len(want)


def test_banded_alignment():
    import numpy as np

    def plain(a, b):
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        return best[-1][-1]

    rng = random.Random(1)
    for _ in range(20):
        a = [rng.randrange(50) for _ in range(60)]
        b = [x for x in a if rng.random() > 0.08]
        assert neardup.banded([(np.array(a, np.int32), np.array(b, np.int32), -2)])[0] == plain(a, b)


def test_alignment_warrants_no_more_than_there_is():
    import numpy as np

    rng = random.Random(6)
    for k in range(200):
        a = [rng.choice(WORDS[:60]) for _ in range(120)]
        b = list(a)
        for _ in range(k // 6):
            at = rng.randrange(len(b))
            b[at : at + rng.randrange(2)] = [rng.choice(WORDS[:60])] * rng.randrange(3)
        number = {}
        one, two = neardup._Read(" ".join(a), number), neardup._Read(" ".join(b), number)
        for x in (one, two):
            x.index(len(number) + 1)
        matched = int(neardup.banded([(one.words, two.words, 0)])[0])
        assert neardup._common_at_least(one, two, matched) <= len(np.intersect1d(one.sequences, two.sequences))


def test_alignment_of_very_long_texts():
    import numpy as np

    words = np.arange(70_000, dtype=np.int32) % 997
    assert neardup.banded([(words, words, 0)])[0] == 70_000


def test_sketches_cost_less_than_two_searches_for_words():
    import pandas as pd

    rng = random.Random(8)
    texts = pd.DataFrame({"fp": range(1000), "text": [" ".join(f"v{rng.randrange(10**5)}" for _ in range(200)) for _ in range(1000)]})

    def seconds(work):
        began = time.process_time()
        work()
        return time.process_time() - began

    words = min(seconds(lambda: [re.findall("[a-z0-9]+", t.lower()) for t in texts["text"]]) for _ in range(5))
    assert min(seconds(lambda: list(neardup._sketches(iter([texts])))) for _ in range(5)) < 2 * words


def test_hashed_words_are_the_words_of_the_lower_cased_text(monkeypatch):
    monkeypatch.setattr(neardup, "PIECE", 16)
    texts = ["", "One two-TWO", " Stra\u00dfe \u0130x 9\u212a.", "\u00e9", "x" * 50 + " one", "ONE 9K two\n", "i x one"]
    words, sizes = neardup.hashed_words(texts)
    plain = [re.findall("[a-z0-9]+", t.lower()) for t in texts]
    assert sizes.tolist() == [len(w) for w in plain]
    flat = [w for text in plain for w in text]
    assert len(set(zip(flat, words.tolist()))) == len(set(flat)) == len(set(words.tolist()))


def test_keys_of_a_text_do_not_depend_on_its_batch():
    import pandas as pd

    rng = random.Random(9)
    texts = pd.DataFrame({"fp": range(300), "text": [" ".join(rng.choice("abc") for _ in range(400)) for _ in range(300)]})
    whole = pd.concat(neardup._sketches(iter([texts])))
    alone = pd.concat(pd.concat(neardup._sketches(iter([texts[i : i + 1]]))) for i in range(300))
    assert whole.values.tolist() == alone.values.tolist()


def test_cells_over_several_batches_lose_no_pair(monkeypatch):
    import pyarrow as pa

    rng = random.Random(10)
    rows = sorted((cell, rng.randrange(-20, 20)) for cell in (rng.choice([-7, 1, 2, *range(3, 60)]) for _ in range(300)))
    want = {(a, b) for cell, a in rows for other, b in rows if cell == other and a < b}
    for size, most in ((1, 10**6), (7, 5), (300, 5), (300, 10**6)):
        monkeypatch.setattr(neardup, "PAIRS", most)
        batches = []
        for at in range(0, len(rows), size):
            cell, fp = (pa.array(x, pa.int64()) for x in zip(*rows[at : at + size]))
            batches += [pa.RecordBatch.from_arrays([cell, fp, cell, cell], ["cell", "fp", "sign", "more"])]
        assert {tuple(r.values()) for out in neardup._met(iter(batches)) for r in out.to_pylist()} == want


def test_only_texts_of_candidates_are_moved(spark, monkeypatch):
    texts = neardup.fingerprinted(spark.createDataFrame([(i, f"word{i} " * 120) for i in range(200)], "id long, text string"), "id", "text")
    fps = texts.where("id < 3").select("fp")
    wanted = {r.fp for r in fps.collect()}
    joined = neardup._bodies(texts, fps)
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    # The marks stand between the join with what is wanted and the texts.
    assert "shiftleft" in plan and "LeftSemi" not in plan
    assert {r.fp for r in joined.collect()} == wanted
    monkeypatch.setattr(neardup, "MARKS", 1)
    assert {r.fp for r in neardup._bodies(texts, fps).collect()} == wanted


def test_keys_are_shuffled_and_sorted_once(spark):
    texts = neardup.fingerprinted(spark.createDataFrame([(1, "a b " * 120)], "id long, text string"), "id", "text")
    plan = neardup.candidates(texts)._jdf.queryExecution().optimizedPlan().toString()
    assert "cell_a" not in plan and plan.count("RepartitionByExpression [cell") == 1


def test_no_records(spark):
    empty = spark.createDataFrame([], "id long, text string")
    assert neardup.near_duplicate_pairs(empty, "id", "text").count() == 0
    assert neardup.near_duplicate_groups(empty, "id", "text").count() == 0


# 3


@pytest.mark.parametrize("question,answer,defect", [
    ("Is it fair?\nReply Yes or No.", None, "empty"), ("Is it fair?", " ​ ", "empty"), ("Is it fair?", "(no answer)", "empty"), ("Is it fair?", "…", "empty"), ("Is it fair?", "N/A", "empty"),
    ("Is it fair?\nReply Yes or No.", "Yes", None), ("Is it fair?", "No", None), ("Pick one: Strongly agree, Agree", "Strongly disagr", "truncated"), ("Pick one: Strongly agree, Agree", "Nein", "other_language"),
    ("Describe the dispute over the tariff.", "The court met. The desk bought bills in the", "truncated"), ("Describe the dispute over the tariff.", "The court met.\n- the growers\n- the county", None),
    ("Describe the dispute over the tariff.", "It stands. Dunwick v. Harford, 220 Tid. Rep. 865 (2006)", None), ("Describe it.", "“The court met and went home.”", None), ("Describe it.", "“The court met and went home.", "truncated"),
    ("Is it fair? Give your reasons before the verdict.", "The court met.\nAnswer: Yes", None), ("Is it fair? Give your reasons before the verdict.", "The court met.\nAnswer:", "truncated"), ("Is it fair? Give your reasons before the verdict.", "The court met.", "truncated"),
    ("Write documents. Return JSON.", '{"documents": ["a b."]}', None), ("Write documents. Return JSON.", '{"documents": ["a b', "truncated"), ("Write documents. Return JSON.", '```json\n{"documents": ["a b."]}\n```', None), ("Write documents. Return JSON.", '```json\n{"documents": ["a b."]}', "truncated"),
    ("Write documents. Return JSON.", '{"documents": []}', "empty"), ("Write documents. Return JSON.", '{"documents": ["I am sorry, but I can\'t help with that."]}', "refusal"), ("Is it fair?", "My guidelines do not let me weigh in on this.", "refusal"),
    ("Is it fair?", "I'm sorry, but I can't help with that.", "refusal"), ("Is it fair?", "As a language model, I must decline to give a view here.", "refusal"), ("Est-ce juste, selon la loi ?", "Je ne peux pas répondre à cette question.", "refusal"), ("Ist das gerecht und gut für die Stadt?", "Leider kann ich dazu nichts sagen.", "refusal"),
    ("Describe the case.", "The court declined to answer the first point, and I cannot say it was wrong.", None), ("Describe the case.", "Sorry as the outcome was for Elkdale, the rule is sound.", None), ("Describe the case.", "I cannot see how the tariff survives the act.", None),
    ("Was the court right to say that the union delayed the tariff?", "Was the court right to say that the union delayed the tariff?", "copy"), ("Was the court right to say that the union delayed the tariff?", "You asked: Was the court right to say that the union delayed the tariff?", "copy"),
    ("Put this sentence into French: The court met in the old hall.", "La cour est réunie dans la vieille salle.", None), ("What did the court say of the old hall?", "La cour est réunie dans la vieille salle.", "other_language"), ("What did the court say of the old hall?", "Суд собрался в старом зале.", "other_language"),
])
def test_defect(question, answer, defect):
    assert (pairs.defects(question, answer) or [None])[0] == defect


def test_defects_of_long_answers():
    no = "I'm sorry, but I cannot help with that request."
    assert pairs.defects("Describe the case.", " ".join([no] * 17)) == ["refusal"]
    told = " ".join(f"The court met on day {i} and heard the clerk of the county." for i in range(30))
    assert pairs.defects("Describe the case.", f"{no} {told}") == []
    assert pairs.defects(told, told) == ["copy"] and pairs.defects(told, f"{told} {told} {told}") == ["copy"]
    item = "- " + " ".join(f"growers of county {i}" for i in range(60))
    assert pairs.defects("Describe the dispute over the tariff.", f"The court met.\n{item}") == []
    reasons = told + " Answer: Yes"
    assert pairs.defects("Is it fair? Give your reasons before the verdict.", reasons) == []


def test_pairs_of_tables(spark):
    train = spark.createDataFrame([(1, "System: s\n\nUser: Is it fair?\n\nAssistant: Yes\n\nUser: And that?\n\nAssistant:", None, 9), (1, "User: And that?\n\nAssistant:", None, 9), (2, "", "raw text", 9), (3, None, None, 9), (4, "User: Fair?\n\nAssistant:", " Yes", 9)], "train_id long, prompt_str string, response_str string, question int")
    rows = pairs.rendered_pairs(train).collect()
    assert {(r.pair_id, r.question) for r in rows} == {(1, "And that?"), (4, "Fair?")}
    run = [(10, 1, 0, "User", "Is it?"), (11, 1, 1, " ASSISTANT ", "(no answer)"), (11, 1, 1, "assistant", "(no answer)"), (12, 2, 0, "assistant", ""), (13, None, 0, "user", "q"), (14, None, 1, "assistant", ""), (15, 3, 0, "user", None), (16, 3, 1, "assistant", None)]
    made = pairs.message_pairs(spark.createDataFrame(run, "msg_id long, record_id long, turn int, role string, content string"))
    both = pairs.named_defect(pairs.broken_pairs(made.unionByName(pairs.rendered_pairs(train))))
    assert {tuple(r) for r in both.collect()} == {("run", 11, "empty"), ("run", 16, "empty"), ("train", 1, "empty")}
    assert pairs.named_defect(pairs.broken_pairs(made.limit(0))).count() == 0


# 4


def test_leaks_equal_brute_force(spark):
    rng = random.Random(9)
    items = [(f"i{k}", _text(rng, 30) + "?") for k in range(12)] + [("short", "too few words"), ("none", None), ("i0", _text(rng, 15))]
    texts = []
    for k in range(60):
        words = _text(rng, 40).split()
        source = rng.choice(items[:12])[1].split()
        n = rng.choice([5, 11, 12, 20, 30])
        at = rng.randrange(len(source) - n + 1)
        words[20:20] = [w.upper() + rng.choice(["", ",", " —"]) for w in source[at : at + n]]
        texts.append((k, " ".join(words)))
    texts += [(98, None), (99, ""), (100, texts[0][1] * 200)]
    corpus = leakage.corpus("t", spark.createDataFrame(texts + texts[:5], "k long, body string").withColumn("tab", F.lit(1)), "k", "body")
    items_df = spark.createDataFrame(items, "item_id string, item_text string")

    def words(t):
        return re.findall("[a-z0-9]+", (t or "").lower())

    want = set()
    for k, t in texts:
        joined = " " + " ".join(words(t)) + " "
        for item, text in items:
            w = words(text)
            if any(" " + " ".join(w[i : i + 12]) + " " in joined for i in range(len(w) - 11)):
                want.add(("t", k, item))
    found = leakage.leaked_passages(corpus, items_df)
    assert {tuple(r) for r in leakage.leaked_rows(found).collect()} == want
    blocks = leakage.leaked_passages(corpus, items_df, max_words=100)
    assert {tuple(r) for r in leakage.leaked_rows(blocks).collect()} == want
    body = dict(texts)
    for r in found.where("row_id < 60").collect():
        assert len(words(body[r.row_id][r.start : r.end])) == r.n_words >= 12
    shifted = spark.createDataFrame([(1, "İİİ — " + items[3][1].upper())], "k long, body string")
    [hit] = leakage.leaked_passages(leakage.corpus("t", shifted, "k", "body"), items_df).collect()
    assert (hit.start, hit.end) == (6, 6 + len(items[3][1]) - 1)
    assert leakage.leaked_passages(corpus.limit(0), items_df).count() == 0
    assert leakage.leaked_passages(corpus, items_df.limit(0)).count() == 0


# 5


def test_packing_places_every_token_once(spark):
    rng = random.Random(2)
    sizes = [rng.choice([3, 50, 50, 50, 120, 260, 400, rng.randrange(1, 512)]) for _ in range(1500)] + [0, 512, 513, 1024, 3000]
    items = spark.createDataFrame([(i, s, "x") for i, s in enumerate(sizes)] + [(5, sizes[5], "again")], "k long, n long, spec_name string")
    specs = spark.createDataFrame([("a", 512), ("b", 1024)], "spec_name string, capacity_tokens int")
    placed = packing.packed(items, specs, "k", F.col("n"))
    rows = placed.collect()
    for name, capacity in (("a", 512), ("b", 1024)):
        own = [r for r in rows if r.spec_name == name]
        total = {}
        for r in own:
            total[r.item_id] = total.get(r.item_id, 0) + r.n_tokens
            assert r.n_tokens == sizes[r.item_id] or sizes[r.item_id] > capacity
        assert total == dict(enumerate(sizes))
        held = {}
        for r in own:
            if r.n_tokens:
                held.setdefault(r.container, []).append(r)
        for parts in held.values():
            parts.sort(key=lambda r: r.position)
            assert [r.position for r in parts] == list(range(len(parts)))
            at = 0
            for r in parts:
                assert r.start == at
                at += r.n_tokens
            assert at <= capacity
        assert set(held) == set(range(1, max(held) + 1))
        room = []
        for n in sorted((n % capacity if n > capacity else n for n in sizes), reverse=True):
            at = next((i for i, free in enumerate(room) if free >= n), None)
            if n and at is None:
                room.append(capacity - n)
            elif n:
                room[at] -= n
        assert len(held) <= 1.02 * (len(room) + sum(n // capacity for n in sizes if n > capacity)) + 1
    assert packing.packed(items.limit(0), specs, "k", F.col("n")).count() == 0
    assert packing.packed(items, specs.limit(0), "k", F.col("n")).count() == 0


def test_packing_takes_most_pieces_from_the_linear_program():
    import numpy as np

    rng = np.random.default_rng(5)
    lengths = np.minimum(np.exp(rng.normal(5.3, 0.9, 20000)).astype(int) + 1, 512)
    sizes, wanted = np.unique(lengths, return_counts=True)
    covered, *_ = packing.relaxed(sizes, wanted.astype(float), 512, 0.016)
    assert len(covered) == len(sizes) and covered.min() >= packing.COVERED
    taken, left = packing.configured(sizes, wanted, 512)
    assert left.min() >= 0 and sum(n * c.astype(int) @ sizes for n, c in taken) + left @ sizes == wanted @ sizes
    assert max(int(c.astype(int) @ sizes) for _, c in taken) <= 512 and left.sum() < 0.1 * wanted.sum()
    assert sum(n for n, _ in packing.solve(sizes, wanted, 512)) < 1.03 * (wanted @ sizes) / 512


@pytest.mark.parametrize("sizes, wanted, least", [([300], [10], 10), ([200, 300], [3, 100], 100), ([512], [4], 4), ([1], [5], 1), ([1, 511], [7, 7], 7)])
def test_packing_of_few_lengths(sizes, wanted, least):
    import numpy as np

    out = packing.solve(np.array(sizes), np.array(wanted), 512)
    assert sum(n * c.astype(int) for n, c in out).tolist() == wanted and sum(n for n, _ in out) <= least + 2


# 6


def test_mixture_meets_shares_and_caps(spark):
    rng = random.Random(4)
    docs = [(i, rng.choices(["big", "mid", "small", None], [70, 25, 4, 1])[0], rng.randrange(20, 300)) for i in range(3000)] + [(9000, "big", 0), (9001, "big", None)]
    sized = mixing.sized(spark.createDataFrame(docs + docs[:10], "doc_id long, source string, n long"), "doc_id", "source", F.col("n"))
    rows = [("m", "big", 0.5, 1), ("m", "mid", 0.3, 2), ("m", "small", 0.2, 4), ("m", "absent", 0.1, 2), ("m2", "big", 1.0, None)]
    targets = spark.createDataFrame(rows, "mix_name string, source string, target_share double, max_repeats int")
    mixed = mixing.mixed(sized, targets)
    got = {(r.mix_name, r.source): r for r in mixing.shares(mixed, targets).collect()}
    for name, share in (("big", 0.5 / 1.0), ("mid", 0.3), ("small", 0.2)):
        assert abs(got["m", name].actual_share - share) < 0.01
    assert got["m", "absent"].n_tokens == 0 and got["m2", "big"].actual_share == 1.0
    assert got["m", "small"].most_uses <= 4 and got["m", "mid"].most_uses <= 2 and got["m", "big"].most_uses == 1
    chosen = [r for r in mixed.collect() if r.mix_name == "m"]
    assert sorted(r.position for r in chosen) == list(range(len(chosen)))
    chosen.sort(key=lambda r: r.position)
    assert all(a.training_time <= b.training_time for a, b in zip(chosen, chosen[1:]))
    assert all(n <= 4 for n in {(r.doc_id): 0 for r in chosen}.values())
    assert mixing.mixed(sized.limit(0), targets).count() == 0 and mixing.mixed(sized, targets.limit(0)).count() == 0


# 7


@pytest.mark.parametrize("text,want", [
    ("The court met.", "whole"), ("The court met in the", "cut"), ("The court m", "cut"), ("The court met. Affirmed", "whole"), ("The court met.\n\nBy Silas Garton", "doubtful"), ("He said “so.”", "whole"), ("The court met. Will...", "cut"),
    ("The court met &hellip;", "cut"), ("before<", "cut"), ("tight rem�", "cut"), ("See Dunmere v. Morlow, 441 Tid.", "cut"), ("The court met.\n* * *", "whole"), ("fell 14.", "doubtful"), ("", "whole"), ("It met. Yours, Avis Hale", "doubtful"), ("Il a vu la chambre.\nFin", "whole"),
])
def test_ending(text, want):
    assert truncation.ending(text) == want


def test_cut_texts(spark):
    rng = random.Random(8)
    rows = []
    for i in range(400):
        whole = ". ".join(_text(rng, 9).capitalize() for _ in range(rng.randrange(3, 30))) + "."
        rows.append((i, whole[:300] if i % 2 else whole, "limited" if i % 2 else "free", whole))
    rows += [(900, None, "free", ""), (901, "  ", None, ""), (902, "ends in the mid", None, ""), (903, "Whole. " * 30000, "free", "")]
    df = spark.createDataFrame([(a, b, c, 1) for a, b, c, _ in rows], "doc_id long, text string, source string, n_chars int")
    got = {r.doc_id: r for r in truncation.cut_texts(df).collect()}
    assert len(got) == len(rows)
    for i, stored, source, whole in rows[:400]:
        assert got[i].is_cut == (len(stored) < len(whole) and not stored.endswith("."))
    assert not got[900].is_cut and not got[901].is_cut and got[902].is_cut and not got[903].is_cut
    tops = {(r.source, r.unit, r["size"]) for r in truncation.limits(truncation.measured(df, "doc_id", "text", "source")).collect()}
    assert ("limited", "chars", 300) in tops and not any(s == "free" for s, _, _ in tops)
    assert all(r.cut_by == ("limit" if r.source == "limited" else "transfer") for r in got.values() if r.is_cut)
    shares = {r.source: r for r in truncation.cut_shares(truncation.cut_texts(df)).collect()}
    assert shares["(none)"].n_cut == 1 and shares["free"].cut_share == 0
    assert truncation.cut_texts(df.limit(0)).count() == 0


def test_limits_in_bytes_and_words_at_the_top(spark):
    rows, rng = [], random.Random(3)
    for i in range(60):
        words = " ".join(_text(rng, 60).split()[:50])
        rows.append((i, words, "words"))
        broken = ("é" * (100 + i) + "aé" * 400).encode()[:501].decode(errors="replace")
        rows.append((100 + i, broken, "bytes"))
    rows += [(500 + i, " ".join(_text(rng, 20 + i).split()) + ".", s) for i in range(25) for s in ("words", "bytes")]
    got = {(r.doc_id, r.source): r for r in truncation.cut_texts(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert all(got[i, "words"].limit_unit and got[i, "words"].cut_by == "limit" for i in range(60))
    assert sum(got[i, "words"].limit_unit == "words" for i in range(60)) > 30
    assert all(got[100 + i, "bytes"].limit_unit == "bytes" and got[100 + i, "bytes"].cut_by == "limit" for i in range(60))
    assert not any(r.is_cut for (i, _), r in got.items() if i >= 500)


def test_limits_decide_most_rows_of_the_given_tables(spark):
    import os

    if not os.path.isdir("/root/testdata/sf0.01"):
        pytest.skip("no test data")
    by = {r.cut_by: r.n for r in truncation.cut_texts(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).groupBy("cut_by").agg(F.count("*").alias("n")).collect()}
    assert by["limit"] >= 3 * by["transfer"]
