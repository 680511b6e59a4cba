"""Operators on small tables: nulls, ties, empty tables, repeated rows, clashing names."""

import json

import pytest
from pyspark.sql import functions as F

from yearloom.functions import statistics, text
from yearloom.operators import chat, evaluation, graph, joins, panel, parsing, ranking, selection
from yearloom.sources import registry, sinks


def test_quadratic_and_shape(spark):
    rows = [("p", x, -2.0 * x * x + 3 * x + 1) for x in range(-5, 6)] + [("few", 0, 1.0), ("few", 1, 3.0), ("up", 0, None)]
    fits = panel.quadratic(spark.createDataFrame(rows, "policy_id string, rel_year int, p_yes double"), ["policy_id"])
    got = {r.policy_id: r for r in panel.n_shaped(fits).collect()}
    assert [round(got["p"][c], 6) for c in "abc"] == [-2, 3, 1] and got["p"].n_shape
    assert (got["few"].a, got["few"].c, got["few"].n_shape) == (0, 2, False) and "up" not in got


@pytest.mark.parametrize("f,want", [(lambda x: -x * x / 100 + 0.5, True), (lambda x: x * x / 100 + 0.2, False), (lambda x: -((x - 8) ** 2) / 100 + 0.5, False)])
def test_n_shape_cases(spark, f, want):
    rows = [("p", x, float(f(x))) for x in range(-10, 11)]
    fits = panel.quadratic(spark.createDataFrame(rows, "policy_id string, rel_year int, p_yes double"), ["policy_id"])
    assert panel.n_shaped(fits).first().n_shape is want


def test_panel_drops_unusable_and_flat_policies(spark):
    rows = [("a", 1950, y, float(y)) for y in range(1945, 1952)] + [("flat", 1950, y, 1.0) for y in range(1945, 1952)] + [("none", None, 1950, 1.0), ("a", 1950, 1960, None)]
    p = panel.tidy(spark.createDataFrame(rows, "policy_id string, enactment_year int, year_model int, p_yes double"))
    assert p.count() == 14 and {r.rel_year for r in p.collect()} == set(range(-5, 2))
    assert {r.policy_id for r in panel.z_scored(p).collect()} == {"a"}
    assert {r.policy_id: r.slope for r in panel.slopes(p).collect()} == {"a": 1.0, "flat": 0.0}
    empty = p.limit(0)
    assert panel.z_curve(empty).count() == 0 and panel.sign_test(panel.slopes(empty)).first().p_value is None


def test_statistics(spark):
    one = spark.createDataFrame([([1.0, 3.0, 3.0],), ([],), (None,)], "v array<double>")
    got = one.select(statistics.argmax(F.col("v")).alias("a"), statistics.softmax(F.col("v")).alias("s")).collect()
    assert got[0].a == 1 and abs(sum(got[0].s) - 1) < 1e-12 and got[1].s == [] and got[2].s is None
    import math

    e = spark.range(1).select(*[statistics.erf(F.lit(x)).alias(str(i)) for i, x in enumerate((-1.5, 0.0, 0.3, 2.0))]).first()
    assert all(abs(v - math.erf(x)) < 2e-7 for v, x in zip(e, (-1.5, 0.0, 0.3, 2.0)))


def test_text_functions(spark):
    df = spark.createDataFrame([("  a \n b ", "#### 1,234.50 then #### 72.0", "12.7"), ("", "none", "n/a"), (None, None, None)], "t string, g string, n string")
    got = df.select(text.squash(F.col("t")), text.word_count(F.col("t")), text.last_marked_number(F.col("g")), text.first_marked_number(F.col("g")), text.whole_number(F.col("n")), text.is_garbage(F.col("t"))).collect()
    assert tuple(got[0]) == ("a b", 2, "72", "1234.50", 12, False)
    assert tuple(got[1]) == ("", 0, None, None, None, True)
    assert tuple(got[2])[:5] == (None, None, None, None, None)
    long = spark.createDataFrame([(" ".join(map(str, range(1000))),)], "t string").select(F.explode(text.chunks(F.col("t"), 400, 201)).alias("c")).collect()
    assert [len(r.c.split()) for r in long] == [400, 400]
    names = spark.createDataFrame([("policy_1950_nanochat_exp2.5_n5000_sft",), ("not_a_window_name",)], "e string").select(text.experiment_parts(F.col("e")).alias("p")).collect()
    assert tuple(names[0].p) == (1950, "nanochat", "exp2.5", 5000, True) and set(names[1].p) == {None}


def test_parsing(spark):
    replies = ['{"documents": ["a", {"text": "b"}, ""]}', '```json\n["c"]\n```', "no json", None, '{"docs": []}', '{"items": ["d"']
    df = spark.createDataFrame([(i, r) for i, r in enumerate(replies)], "k int, reply string")
    assert {(r.k, r.text) for r in parsing.exploded_documents(df, "reply", ["k"]).collect()} == {(0, "a"), (0, "b"), (1, "c")}
    assert [r.s for r in df.orderBy("k").select(parsing.reply_status(F.col("reply")).alias("s")).collect()] == ["ok", "ok", "parse_failed", "error", "parse_failed", "parse_failed"]
    keys = spark.createDataFrame([("year=1942;seed=487",), ("seed=x",), (None,)], "c string").select(parsing.request_key(F.col("c")).alias("k")).collect()
    assert tuple(keys[0].k) == (1942, 487) and set(keys[1].k) == {None}


def test_chat(spark):
    turns = [(1, 0, "System", "s"), (1, 1, "USER", "q"), (1, 2, "assistant", "an swer"), (1, 2, "assistant", "an swer"), (2, 0, "assistant", "x"), (3, 0, "user", None), (3, 1, "user", "b")]
    got = {r.r: r for r in chat.messages(spark.createDataFrame(turns, "r int, t int, role string, c string"), "r", "t", "role", "c").select("r", chat.rendered(F.col("messages")).alias("body"), chat.conversation_status(F.col("messages")).alias("s"), chat.token_mask(F.col("messages")).alias("m")).collect()}
    assert got[1].body == "System: s\n\nUser: q\n\nAssistant: an swer" and got[1].s == "ok" and [x["mask"] for x in got[1].m] == [0, 0, 1, 1]
    assert got[2].s == "too_short" and got[3].s == "bad_roles"
    parts = spark.createDataFrame([("User: q\n\nAssistant: a",), ("Assistant: a",)], "b string").select(chat.split_prompt(F.col("b")).alias("p")).collect()
    assert tuple(parts[0].p) == ("User: q\n\nAssistant:", " a") and tuple(parts[1].p) == ("", "Assistant: a")


def test_packed_sequences_cover_whole_sequences(spark):
    sizes = [3, 0, 17, 5, 9, 30]
    docs = spark.createDataFrame(list(enumerate(sizes)), "d int, n int")
    rows = chat.packed_sequences(docs, "d", "n", 8).collect()
    whole = sum(n + 1 for n in sizes) // 8
    fill = {}
    for r in rows:
        fill[r.seq_id] = fill.get(r.seq_id, 0) + r.n
    assert fill == {i: 8 for i in range(whole)}
    assert chat.packed_sequences(docs.limit(0), "d", "n", 8).count() == 0


def test_overlapping_sequences_share_one_token(spark):
    sizes = [3, 0, 17, 5, 9, 30, 1, 1]
    docs = spark.createDataFrame(list(enumerate(sizes)), "d int, n int")
    tokens = [(d, i) for d, n in enumerate(sizes) for i in range(n + 1)]
    made = {}
    for r in chat.packed_sequences(docs, "d", "n", 8, overlap=1).collect():
        for k in range(r.n):
            made[r.seq_id, r.offset + k] = (r.d, r.first + k)
    whole = (len(tokens) - 1) // 8
    assert made == {(s, k): tokens[8 * s + k] for s in range(whole) for k in range(9)}


def test_positions_by_digest_equal_one_window(spark):
    df = spark.range(3000).selectExpr("id", "IF(id % 3 = 0, 'hot', IF(id % 7 = 0, NULL, CAST(id % 5 AS STRING))) AS g", "1 AS pos_extra")
    digest = selection.hash_order("s", F.col("id"))
    rows = selection.hash_position(df, ["g"], digest, [F.col("id")], digits=1).collect()
    import hashlib

    by = {}
    for r in rows:
        by.setdefault(r.g, []).append(r)
    for own in by.values():
        own.sort(key=lambda r: hashlib.md5(f"s:{r.id}".encode()).hexdigest())
        assert [r.pos for r in own] == list(range(len(own)))
    assert len(rows) == 3000 and selection.hash_position(df.limit(0), ["g"], digest, [F.col("id")]).count() == 0


def test_any_number_of_phrases(spark):
    phrases = [f"phrase {i}x" for i in range(3000)]
    df = spark.createDataFrame([("a Phrase 2999X here",), ("phrase 17x and phrase 5x",), ("none",), (None,), ("",)], "t string")
    for block in (50_000, 700):
        assert [r[0] for r in df.select(joins.first_phrase(F.col("t"), phrases, block)).collect()] == ["phrase 2999x", "phrase 5x", None, None, None]
    assert df.select(joins.first_phrase(F.col("t"), [])).first()[0] is None


def test_components_that_do_not_settle_are_an_error(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(200)], "a long, b long")
    with pytest.raises(RuntimeError):
        graph.connected_components(chain, most_rounds=2)


def test_long_records_are_validated_to_the_end(spark):
    turns = [(1, 0, "system", "s")] + [(1, i, "user" if i % 2 else "assistant", "x") for i in range(1, 10_051)]
    df = spark.createDataFrame(turns + [(2, *t[1:]) for t in turns[:-1]] + [(2, 10_050, "user", "x")], "r int, t int, role string, c string")
    got = {r.r: r.s for r in chat.messages(df, "r", "t", "role", "c").select("r", chat.conversation_status(F.col("messages")).alias("s")).collect()}
    assert got == {1: "ok", 2: "bad_roles"}


def test_evaluators_by_name(spark):
    from yearloom.operators import evaluators

    assert set(evaluators.names()) == {"policy_battery", "policy_battery_variants", "gsm8k", "policy_probe", "choice", "core_task"}
    with pytest.raises(KeyError):
        evaluators.get("nothing")
    items = spark.createDataFrame([("a", "#### 1,234.50"), ("b", "#### 7"), ("c", None)], "item_id string, expected string")
    replies = spark.createDataFrame([("a", "#### 2 no, #### 1234.5"), ("z", "#### 7")], "item_id string, reply string")
    assert tuple(evaluators.get("gsm8k")(items, replies).first()) == (2, 1, 0.5)
    assert evaluators.get("gsm8k")(items.limit(0), replies).first().accuracy == 0.0
    scores = spark.createDataFrame([("p", 1, [0.0, 0.0], [1.0] * 5), ("p", 1, [0.0, 0.0], None), ("q", 1, None, None)], "event_id string, m int, yes_no array<double>, scale array<double>")
    rows = {r.event_id: r for r in evaluators.get("policy_battery_variants")(spark.createDataFrame([("p",), ("q",), ("r",)], "event_id string"), scores, ["m"]).collect()}
    assert (rows["p"].mean_p_yes, rows["p"].std_p_yes, rows["p"].n_variants, rows["p"].mean_score) == (0.5, 0.0, 2, 0.0) and rows["q"].mean_p_yes is None and "r" not in rows
    losses = spark.createDataFrame([("a", [[9.0, 1.0, 1.0], [0.0, 2.0]], 1)], "item_id string, losses array<array<double>>, start int")
    asked = spark.createDataFrame([("a", "A")], "item_id string, expected string")
    assert evaluators.get("core_task")(asked, losses).first().accuracy == 1.0


def test_reply_forms(spark):
    replies = ['{"ideas": [{"doc_type": "memo", "concept": "c"}, {"doc_type": "memo"}, {"doc_type": " ", "concept": "c"}]}', '```json\n[{"doc_type": "d", "concept": "e", "tone": "dry"}]\n```', "no json", None, "[]"]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(replies)], "k int, r string")
    got = {r.k: [tuple(i) for i in r.v] if r.v is not None else None for r in df.select("k", parsing.ideas(F.col("r")).alias("v")).collect()}
    assert got[0] == [("memo", "c", "")] and got[1] == [("d", "e", "dry")] and not got[2] and got[3] is None and got[4] == []
    one = spark.createDataFrame([('{"text": "a"}',), ('"b\\n"',), ('{"other": 1}',), ("",), (None,)], "r string").select(parsing.single_document(F.col("r"))).collect()
    assert [r[0] for r in one] == ["a", "b\n", None, None, None]
    made = spark.createDataFrame([('{"data": [{"question": "q", "answer": "#### 1"}, {"question": "q", "answer": "1"}]}', '{"variants": [" a ", "", "b"]}')], "p string, v string")
    row = made.select(parsing.problems(F.col("p")), parsing.variants(F.col("v"))).first()
    assert [tuple(x) for x in row[0]] == [("q", "#### 1")] and row[1] == ["a", "b"]


def test_state_keeps_the_latest_row(spark):
    from yearloom.streaming import windows

    old = spark.createDataFrame([(1, "a", 5), (2, "b", 5)], "k int, v string, at int")
    new = spark.createDataFrame([(1, "late", 4), (2, "c", 6), (3, "d", 1)], "k int, v string, at int")
    assert {(r.k, r.v) for r in windows.upsert_state(old, new, "k", ["at"]).collect()} == {(1, "a"), (2, "c"), (3, "d")}


def test_joins(spark):
    left = spark.createDataFrame([(1, "a", 5), (2, "a", 1), (3, "b", 9)], "k int, g string, at int")
    right = spark.createDataFrame([("a", 2, 20), ("a", 5, 50), ("c", 1, 1)], "g string, t int, v int")
    assert {r.k: r.v for r in joins.as_of(left, right, ["g"], "at", "t", "v").collect()} == {1: 50, 2: None, 3: None}
    assert joins.window_bounds(rel_max=20) == (20, 10) and joins.window_bounds(window_years=5) == (5, 5) and joins.window_bounds(lookback_years=10) == (0, 10)
    with pytest.raises(ValueError):
        joins.window_bounds()
    t = spark.createDataFrame([("The Tariff and the bank",), ("none",), (None,)], "t string")
    got = t.select(joins.matched_topics(F.col("t"), {"money": ["tariff", "bank"], "work": ["wage"]}).alias("m"), joins.first_phrase(F.col("t"), ["bank", "tariff"]).alias("p")).collect()
    assert (got[0].m, got[0].p) == (["money"], "bank") and got[1].p is None


def test_components(spark):
    chain = [(i, i + 1) for i in range(50)] + [(100, 101), (101, 102), (102, 100), (7, 7), (200, 200), (None, 3)]
    got = {r.node: r.component for r in graph.connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert set(got[i] for i in range(51)) == {0} and {got[i] for i in (100, 101, 102)} == {100} and got[200] == 200
    assert graph.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_spread_rank_is_dense_and_sums(spark):
    df = spark.range(500).selectExpr("IF(id < 400, 'hot', IF(id < 450, 'b', NULL)) AS g", "id", "id % 7 AS w", "1 AS rank_extra")
    rows = ranking.spread_rank(df, ["g"], F.col("id"), weight=F.col("w"), cells=8).collect()
    for g in ("hot", "b", None):
        own = sorted((r for r in rows if r.g == g), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(len(own)))
        total = 0
        for r in own:
            assert r.rank_sum == total
            total += r.w


def test_selection(spark):
    df = spark.createDataFrame([("x", i) for i in range(5)] + [(None, 9)], "g string, k int")
    assert selection.first_per_group(df, ["g"], [F.col("k")], 2).count() == 3
    assert selection.even_split(7, ["a", "b", "c"]) == {"a": 3, "b": 2, "c": 2}
    assert selection.interleaved({"a": df, "b": df}, {"a": 2}, "k", "s").count() == 18


def test_evaluation(spark):
    df = spark.createDataFrame([("m", True), (None, False), ("m", False)], "subset string, ok boolean")
    assert {r.part: r.accuracy for r in evaluation.accuracy_rollup(df, F.col("ok"), "subset").collect()} == {"m": 0.5, "unknown": 0.0, "overall": 0.333333}
    assert evaluation.accuracy(df.limit(0), F.col("ok")).first().accuracy == 0.0
    loss = spark.createDataFrame([(1.0, 2, 5), (9.0, 0, 5), (9.0, 2, -1)], "nats double, b int, t int")
    import math

    assert abs(evaluation.bits_per_byte(loss, "nats", "b", "t").first()[0] - round(1 / (2 * math.log(2)), 6)) < 1e-9
    assert evaluation.bits_per_byte(loss.limit(0), "nats", "b", "t").first()[0] == math.inf

    def broken(prompts, options):
        raise RuntimeError("down")

    prompts = spark.createDataFrame([(1, "p", ["a", "b"])], "k int, p string, o array<string>")
    assert evaluation.score_options(prompts, "k", "p", "o", broken).first().error == "down"


def test_sources_and_sinks(spark, tmp_path):
    folder = str(tmp_path)
    rows = [("i1", "Court", "English", 120, "word " * 120), ("i2", "Court", "French", 120, "mot"), ("i3", "Court", "English", 50, "short"), ("i4", "Court", "English", 150, None)]
    spark.createDataFrame(rows, "identifier string, collection string, language string, word_count int, text string").coalesce(1).write.parquet(f"{folder}/raw/1950")
    import glob
    import os

    for i, f in enumerate(sorted(glob.glob(f"{folder}/raw/1950/*.parquet"))):
        os.rename(f, f"{folder}/raw/1950/subset_{i}.parquet")
    got = registry.get("bulk_corpus")(spark, f"{folder}/raw", registry.Wanted()).collect()
    assert [(r.doc_id, r.source, r.year) for r in got] == [("i1", "bulk_corpus:Court", 1950)]
    with pytest.raises(KeyError):
        registry.get("nowhere")
    os.makedirs(f"{folder}/gst")
    with open(f"{folder}/gst/descr_097.txt", "w") as f:
        f.write("speech_id|chamber|date|" + "|".join("x" * 10) + "|word_count\n" + "".join(f"{i}|H|19810105|" + "|".join("x" * 10) + f"|{n}\n" for i, n in ((1, 250), (2, 20), (1, 250))))
    with open(f"{folder}/gst/speeches_097.txt", "w") as f:
        f.write("speech_id|speech\n1|a | b | c\n2|short\nno separator\n3|unknown\n")
    said = registry.get("floor_speeches")(spark, f"{folder}/gst", registry.Wanted()).collect()
    assert [(r.doc_id, r.text, r.year) for r in said] == [("1", "a | b | c", 1981)]
    with open(f"{folder}/seeds.txt", "w") as f:
        f.write("one\n---\ntwo\n---\n \n")
    assert sorted(r.text for r in registry.documents_of(spark, f"{folder}/seeds.txt").collect()) == ["one", "two"]
    os.makedirs(f"{folder}/eval/m")
    with open(f"{folder}/eval/m/eval.json", "w") as f:
        json.dump({"experiment": "policy_1950_x_n5", "results": {"policies": [{"id": "p", "implementation_year": 1960, "scores": {"yes_no": {"p_yes": 0.5}}}]}}, f)
    row = registry.evaluation_files(spark, f"{folder}/eval").first()
    assert (row.year_model, row.policy_id, row.p_yes, row.likert) == (1950, "p", 0.5, None)
    status = spark.createDataFrame([(1, "ok"), (2, "error")], "k int, status string")
    sinks.write_records(status, f"{folder}/out", "status")
    assert spark.read.json(f"{folder}/out/failures").first().status == "error"
    sinks.write_tidy(spark.createDataFrame([(1, 0.5), (2, None)], "k int, v double"), f"{folder}/tidy", ["v", "k"])
    assert sorted((r.v or "", r.k) for r in spark.read.csv(f"{folder}/tidy", header=True).collect()) == [("", "2"), ("0.500000", "1")]
    assert sinks.markdown(status.orderBy("k")).splitlines()[2] == "| 1 | ok |"
    sinks.write_years(spark.createDataFrame([(1950, "a")], "year int, t string"), f"{folder}/years")
    sinks.write_years(spark.createDataFrame([(1950, "late"), (1951, "b")], "year int, t string"), f"{folder}/years", done=spark.createDataFrame([(1950,)], "year int"))
    assert spark.read.parquet(f"{folder}/years").count() == 2


def test_more_sources(spark, tmp_path):
    import os

    folder = str(tmp_path)
    for edition, year, word in (("bound", 1981, "old"), ("daily", 1981, "twice"), ("daily", 2012, "new")):
        os.makedirs(f"{folder}/gst/{edition}", exist_ok=True)
        with open(f"{folder}/gst/{edition}/descr_{97 if year < 2000 else 112:03d}.txt", "w") as f:
            f.write(f"id|c|d|{'|'.join('x' * 10)}|n\n1|H|{year}0105|{'|'.join('x' * 10)}|100\n1|H|{year}0105|{'|'.join('x' * 10)}|250\n")
        with open(f"{folder}/gst/{edition}/speeches_{97 if year < 2000 else 112:03d}.txt", "w") as f:
            f.write(f"id|speech\n1|{word} words\n")
    said = registry.get("floor_speeches")(spark, f"{folder}/gst", registry.Wanted()).collect()
    assert {(r.year, r.text, r.word_count) for r in said} == {(1981, "old words", 250), (2012, "new words", 250)}
    spark.createDataFrame([("id1", "many clean words here " * 40, "12.7e2"), (None, "many clean words here " * 40, None), ("g", "%$#@ " * 300, "300")], "article_id string, ocr_text string, word_count string").coalesce(1).write.parquet(f"{folder}/weekly")
    name = next(f for f in os.listdir(f"{folder}/weekly") if f.endswith(".parquet"))
    os.rename(f"{folder}/weekly/{name}", f"{folder}/weekly/19530102_issue.parquet")
    got = {r.doc_id: (r.year, r.word_count) for r in registry.get("weekly_paper")(spark, f"{folder}/weekly", registry.Wanted()).collect()}
    assert got == {"id1": (1953, 1270), "19530102_issue:1": (1953, 160)}
    os.makedirs(f"{folder}/pages/1960/m1")
    for stem in ("minutes_a", "the_statement", "tealbook"):
        with open(f"{folder}/pages/1960/m1/{stem}.html", "w") as f:
            f.write("<p>" + "word " * 450 + "</p>")
    assert {(r.doc_id, r.word_count) for r in registry.get("meeting_pages")(spark, f"{folder}/pages", registry.Wanted()).collect()} == {("meeting:m1:minutes_a:0", 400), ("meeting:m1:the_statement:0", 400)}
    spark.createDataFrame([("x", "t " * 200, 0, "1971-01-02", 200, "h"), ("y", "t " * 200, 1960, "1971-01-02", 200, None)], "_id string, combined_text string, file_year int, pub_date string, word_count int, headline_main string").write.parquet(f"{folder}/daily")
    daily = registry.get("daily_paper")(spark, f"{folder}/daily", registry.Wanted(last_year=1965))
    assert [(r.doc_id, r.year) for r in daily.collect()] == [("y", 1960)]
    assert [r.doc_id for r in registry.first_passages(registry.get("daily_paper")(spark, f"{folder}/daily", registry.Wanted()), 1, ["doc_id"]).collect()] == ["x"]
    with open(f"{folder}/items.jsonl", "w") as f:
        f.write('{"item_id": "a", "n": 1}\n\n  \nno json\n{"item_id": "b"}\n')
    assert [tuple(r) for r in registry.item_lines(spark, f"{folder}/items.jsonl", "item_id string, n int").where("item_id IS NOT NULL").orderBy("item_id").collect()] == [("a", 1), ("b", None)]
    os.makedirs(f"{folder}/variants")
    with open(f"{folder}/variants/ev-001.jsonl", "w") as f:
        f.write('{"variant_question": " Should it? "}\n{"variant_question": 5}\n{"variant_question": " "}\n\n{"other": "x"}\n')
    assert [tuple(r) for r in registry.variant_files(spark, f"{folder}/variants").collect()] == [("ev-001", "Should it?")]
    with open(f"{folder}/steps.csv", "w") as f:
        f.write("year,step\n1950,100\nx,5\n")
    assert [tuple(r) for r in registry.step_map(spark, f"{folder}/steps.csv").collect()] == [(1950, 100)]
    for i in range(3):
        spark.range(10 * i, 10 * i + 10).coalesce(1).write.parquet(f"{folder}/tmp{i}")
        os.makedirs(f"{folder}/split", exist_ok=True)
        os.rename(next(f"{folder}/tmp{i}/{f}" for f in os.listdir(f"{folder}/tmp{i}") if f.endswith(".parquet")), f"{folder}/split/shard_{i}.parquet")
    assert {r.id for r in registry.split_files(spark, f"{folder}/split", "val").collect()} == set(range(20, 30))
    assert {r.id for r in registry.split_files(spark, f"{folder}/split", "train").collect()} == set(range(20))
    with pytest.raises(ValueError):
        registry.split_files(spark, f"{folder}/split", "test")
    strides = [{r.id for r in registry.strided_rows(spark, f"{folder}/split", k, 3, rows=2).collect()} for k in range(3)]
    assert set.union(*strides) == set(range(30)) and sum(map(len, strides)) == 30 and {0, 1, 6, 7} <= strides[0]
    with open(f"{folder}/chat.jsonl", "w") as f:
        f.write(json.dumps({"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": " a "}]}) + "\n" + json.dumps({"content": "plain"}) + "\n{}\n")
    assert {tuple(r) for r in registry.training_documents(spark, f"{folder}/chat.jsonl").collect()} == {("User: q\n\nAssistant:", " a"), ("", "plain")}
    with open(f"{folder}/lines.txt", "w") as f:
        f.write("one\n\ntwo\n")
    assert sorted(r.text for r in registry.documents_of(spark, f"{folder}/lines.txt").collect()) == ["one", "two"]
    with open(f"{folder}/battery.csv", "w") as f:
        f.write("event_id,event_year,benchmark_question,adoption_object,domain,institution,policy_or_case\ne1,1950, ,a law,d,i,p\ne2,,Is it?,x,d,i,p\n")
    assert {r.event_id: (r.event_year, r.benchmark_question) for r in registry.battery_csv(spark, f"{folder}/battery.csv").collect()} == {"e1": (1950, "Should the United States have a law?"), "e2": (None, "Is it?")}
    sinks.write_records(spark.createDataFrame([(1, None, "ok")], "k int, v string, status string"), f"{folder}/kept", "status")
    assert '"v":null' in spark.read.text(f"{folder}/kept/records").first()[0]


def test_archives_pools_and_envelopes(spark, tmp_path):
    import io
    import tarfile

    folder = str(tmp_path)
    with tarfile.open(f"{folder}/runs.tar", "w") as archive:
        for name, text in (("1950/eval.json", '{"p": 0.5}'), ("x/eval.json", "{}"), ("1951/notes.txt", "no")):
            info = tarfile.TarInfo(name)
            info.size = len(text)
            archive.addfile(info, io.BytesIO(text.encode()))
    assert {(r.year, r.text) for r in registry.archived_lines(spark, f"{folder}/runs.tar").collect()} == {(1950, '{"p": 0.5}'), (None, "{}")}
    pool = spark.createDataFrame([(1950, 0, 7, False)], "year int, pos long, key long, resampled boolean")
    sinks.write_pool(pool, spark.createDataFrame([(1950, 1)], "year int, n_total int"), f"{folder}/p")
    assert spark.read.parquet(f"{folder}/p/pool").first().key == 7 and spark.read.json(f"{folder}/p/manifest").first().n_total == 1
    sinks.write_results(spark.createDataFrame([("arc", None)], "suite string, accuracy double"), f"{folder}/e", "m", "choice")
    assert spark.read.text(f"{folder}/e").first()[0] == '{"experiment":"m","evaluator":"choice","results":{"suite":"arc","accuracy":null}}'


def test_conversation_forms(spark):
    turns = [(1, 0, "system", "s"), (1, 1, "user", "q"), (1, 2, "assistant", "a"), (2, 0, "user", "q"), (3, 0, "system", "s")]
    forms = chat.messages(spark.createDataFrame(turns, "r int, t int, role string, c string"), "r", "t", "role", "c")
    got = {r.r: r for r in forms.select("r", chat.rendered(chat.merged_system(F.col("messages"))).alias("m"), chat.rendered(chat.completion_messages(F.col("messages"))).alias("p")).collect()}
    assert got[1].m == "User: s\n\nq\n\nAssistant: a" and got[1].p == "System: s\n\nUser: q"
    assert (got[2].m, got[2].p) == ("User: q", None) and (got[3].m, got[3].p) == ("System: s", None)


def test_prompt_forms(spark):
    from yearloom.functions import records as R

    df = spark.createDataFrame([("Is it?", ["a", "b"], "B"), (None, ["a"], "AB")], "q string, c array<string>, a string")
    row, other = df.select(R.probe_prompt(F.col("q"), "scale"), R.probe_prompt(F.col("q"), "yes_no", True, True), R.choice_prompt(F.col("q"), F.col("c"), "KV"), R.moved_letter(F.col("a"), "ABCD", "QXZJ"), R.cropped_span(F.lit(3), F.lit(9), F.lit(12), 5)).collect()
    assert row[0].endswith("agreement:\n\nIs it?\n\nAnswer:") and row[1].startswith("User: Is it?\n\nThink") and row[2] == "Is it?\n- a=K\n- b=V\nAnswer:" and row[3] == "X" and tuple(row[4]) == (0, 2)
    assert tuple(other)[:4] == (None, None, None, None)
    with pytest.raises(ValueError):
        R.probe_prompt(F.lit("q"), "other")


def test_text_column_order(spark):
    df = spark.createDataFrame([("a", "b")], "text string, content string")
    assert df.select(registry.text_column(df, ("content", "text"))).first()[0] == "b"
    with pytest.raises(KeyError):
        registry.text_column(df, ("body",))


def test_best_fit_rows_are_full_and_begin_with_a_document(spark):
    import random

    from yearloom.operators import bestfit

    rng = random.Random(6)
    sizes = [rng.randrange(0, 90) for _ in range(400)] + [300]
    docs = spark.createDataFrame(list(enumerate(sizes)), "k long, n int")
    rows = bestfit.best_fit_rows(docs, "k", "n", 64, buffer=20, group_rows=100).collect()
    by = {}
    for r in rows:
        by.setdefault((r.bucket, r.row), []).append(r)
    for parts in by.values():
        parts.sort(key=lambda r: r.offset)
        assert sum(r.n for r in parts) == 64 and [r.offset for r in parts] == [sum(x.n for x in parts[:i]) for i in range(len(parts))]
        assert all(r.n == sizes[r.k] + 1 for r in parts[:-1])
    assert len({r.k for r in rows}) == len(rows)
    assert bestfit.best_fit_rows(docs.limit(0), "k", "n", 64).count() == 0


def test_record_functions(spark):
    from yearloom.functions import records as R

    assert R.ladder_steps("0.5:b,0.001:a,1:c", 100) == [(1, "a"), (50, "b"), (100, "c")]
    df = spark.createDataFrame([([1, 2, 3], [1, 2, 4], "x STOP y"), ([], [1], None)], "a array<int>, b array<int>, t string")
    got = df.select(R.common_prefix(F.col("a"), F.col("b")), R.cropped(F.col("a"), 2), R.padded(F.col("a"), 4, F.lit(0)), R.cut_at(F.col("t"), "STOP")).collect()
    assert tuple(got[0]) == (2, [2, 3], [1, 2, 3, 0], "x ") and tuple(got[1]) == (0, [], [0, 0, 0, 0], None)
