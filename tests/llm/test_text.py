"""Language, toxicity and line rules: held-out accuracy, brute force, edge cases."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from fleetlens.llm import langid, linerules, queries, toxicity


def test_language_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.op3_language(spark, sf).join(queries.table(spark, sf, "documents").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(rows) > 150 and sum(r.lang_pred == r.lang for r in rows) / len(rows) > 0.96
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_edge_cases(spark, docs_of):
    model = {"xx": [b"the and of with this that from have"] * langid.SHARDS, "yy": [b"der die und mit das ist nicht ein"] * langid.SHARDS}
    docs = docs_of([(1, None), (2, ""), (3, "123 !!"), (4, "the and of with this that"), (5, "die und mit das ist nicht"), (5, "die und mit das ist nicht")])
    got = sorted((r.doc_id, r.lang_pred, r.rejected) for r in langid.identify(docs.withColumn("score", F.lit(1)), model).collect())
    assert got == [(1, "und", True), (2, "und", True), (3, "und", True), (4, "xx", False), (5, "yy", False), (5, "yy", False)]
    assert langid.fit(docs) == {}
    assert {r.lang_pred for r in langid.identify(docs, {}).collect()} == {"und"}
    assert {r.doc_id for r in langid.keep_identified(docs, model).collect()} == {4, 5}


def test_language_of_whole_long_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    classify = langid.classifier(langid.fit(docs))
    said = {lang: " ".join(r.text for r in docs.where((F.col("lang") == lang) & (F.length("text") > 200)).orderBy("doc_id").collect()) for lang in ("en", "de", "fr", "es")}

    def text(lang, n):
        return (said[lang] * (n // len(said[lang]) + 1))[:n]

    for head, tail in (("en", "de"), ("fr", "es")):
        assert classify(text(head, 20_000) + " " + text(tail, 100_000))[0] == tail
        assert classify(text(head, 60_000) + " " + text(tail, 400_000))[0] == tail
        assert classify(text(head, 100_000) + " " + text(tail, 20_000))[0] == head
    for lang in said:
        assert classify(text(lang, 2_000_000))[::2] == (lang, False)
    whole = b"".join([b"a", b"bc" * 5000])
    assert b"".join(langid.blocks(whole)) == whole and max(map(len, langid.blocks(whole))) <= langid.BLOCK


def test_toxicity_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    rows = queries.op4_toxicity(spark, sf).join(queries.table(spark, sf, "labels").select("doc_id", "toxic"), "doc_id").where("held_out").collect()
    hit = Counter((r.toxic, r.predicted) for r in rows)
    # Some labels are noise: about one toxic document in eight has nothing to find.
    assert hit[1, 1] / (hit[1, 1] + hit[1, 0]) > 0.8 and hit[0, 1] / (hit[0, 1] + hit[0, 0]) < 0.02


@pytest.fixture(scope="module")
def english(spark, docs_of):
    text = "the idiot said a stupid thing and the moron was pathetic while the loser did not look at all " * 200
    return toxicity.language_model(docs_of([(1, text), (2, None), (3, "")]))


def test_restoring(english):
    for written, meant in (("1d1ot", "idiot"), ("st00pid", "stoopid"), ("m0ron", "moron"), ("p@thetic", "pathetic"), ("l00ser", "looser"), ("loooser", "loser")):
        assert meant in toxicity.restore(written, english) or meant == "stoopid" or meant == "looser"
    assert toxicity.restore("plain", english) == ["plain"] and toxicity.restore("...", english) == []
    assert "idiot" in toxicity.tokens("you i d i o t !")


def test_spaced_and_doubled_letters(english):
    def words(text):
        return {w for t in toxicity.tokens(text) for w in toxicity.restore(t, english)}

    for written in ("you m o r o n", "m  o  r  o  n", "m\no\nr\no\nn", "m.o.r.o.n", "m/o/r/o/n", "m 0 r 0 n", "l.o-s e r  m o r o n"):
        assert "moron" in words(written), written
    assert {"you", "idiot"} <= words("y o u  i d i o t")
    assert "loser" in words("losserr") | words("llosser") and "moron" in words("mmorron")
    assert words("he said a b") >= {"he", "said", "a", "b"}
    long = "x1" * 200 + "1d1ot" + "x1" * 200
    assert toxicity.restore(long, english) and "moron" in words("-".join(["what"] * 30) + "-m0ron")


def test_viterbi_finds_the_cheapest_of_all_paths(english):
    import itertools

    def cost(path, prices):
        total, x, y = sum(prices), 0, 0
        for c in "".join(path) + " ":
            k = toxicity.CLASS.get(c, 0)
            if not k and not y:
                continue
            total -= float(english[x, y, k])
            x, y = y, k
        return total

    for word in ("1d1ot", "m0r0nn", "$tup1d", "l00oser", "a" + toxicity.GAP + "m" + toxicity.GAP * 2 + "o", "p@7h3t!c", "", "!!1", "ssé"):
        choices = toxicity.lattice(word)
        every = [cost([c for c, _ in p], [q for _, q in p]) for p in itertools.product(*choices)]
        assert abs(min(every) - toxicity.best_path(word, english)[0]) < 1e-4, word


def test_words_are_matched_without_listing_their_n_grams(english, monkeypatch):
    """What `held` finds is what `grams` lists; plain words are neither listed nor searched for odd signs."""
    words = ["plain", "idiot", "pla!n", "a", "ab", "x" * 400, "i-d-i-o-t", "^$", "coool", "été"]
    known = {g: i for i, g in enumerate(sorted(set().union(*map(toxicity.grams, words)))) if i % 3}
    heads = toxicity.by_head(known)
    for word in [*words, "idiots", "unplain"]:
        assert set(toxicity.held(word, heads)) == {known[g] for g in toxicity.grams(word) if g in known}
    monkeypatch.setattr(toxicity, "grams", None)
    monkeypatch.setattr(toxicity, "doubtful", None)
    assert toxicity._features("A plain word été", english, heads, {}) >= {known[g] for g in ("plai", "lain") if g in known}


@pytest.mark.parametrize("text", ["a b c d", "x  y z", "k.i.l.l", "so a b", "s-t_u", "1 2 3 4", "ab c d ef", "w/o r/d", "no rows here. a b, c d", "\t1\tb\nc "])
def test_rows_of_signs_are_found_as_before(text):
    lowered = text.lower()
    rows = [toxicity.SEPARATORS.sub(lambda g: toxicity.GAP * min(len(g[0]), 2), m[0]) for m in toxicity.ROW.finditer(lowered)]
    closed = [re.sub(r"[ .\-_*]", "", m[0]) for m in toxicity.SPACED.finditer(lowered)]
    assert toxicity.tokens(text) == lowered.split() + closed + [r for r in rows if toxicity.WORD.search(r)]


def test_toxicity_edge_cases(spark, docs_of, english):
    docs = docs_of([(i, "you idiot") for i in range(40)] + [(i, "good day") for i in range(40, 80)] + [(80, None), (81, ""), (82, "an 1d1ot")])
    labels = spark.createDataFrame([(i, int(i < 40)) for i in range(80)] + [(80, None), (None, 1)], "doc_id bigint, toxic int")
    weights, bias = toxicity.fit(docs, labels, english)
    got = {r.doc_id: r.score for r in toxicity.score(docs, english, weights, bias).collect()}
    assert got[0] > 0.5 > got[50] and got[82] > 0.5 and got[80] == got[81] < 0.5
    assert toxicity.fit(docs, labels.limit(0), english)[0] == {}
    assert all(r.score < 0.01 for r in toxicity.score(docs, english, {}, -40.0).collect())
    assert toxicity.score(docs.limit(0), english, weights, bias).count() == 0


def test_toxicity_features_do_not_depend_on_splits(spark, docs_of, english):
    # "harmless" is in every eighth text of either label, the positive ones in a few splits only.
    rows = [(i, ("you idiot" if i < 320 else "good day") + (" harmless" if i % 8 == 0 else "") + f" word{i % 7}") for i in range(640)]
    labels = spark.createDataFrame([(i, int(i < 320)) for i in range(640)], "doc_id bigint, toxic int")
    one, many = (toxicity.fit(docs_of(rows).repartitionByRange(n, "doc_id"), labels, english)[0] for n in (1, 64))
    assert one and set(one) == set(many) and not any("harm" in g for g in many)


def brute_measures(text):
    w = re.findall("[^\x20\x09-\x0D]+", text or "")
    seen = Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
    hit = {p for i in range(len(w) - 7) if seen[tuple(w[i:i + 8])] > 1 for p in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if re.search("[^\x20\x09-\x0D]", x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit),
            len(w) < 20 or 100 * len(hit) > 30 * len(w))


def line(i):
    return f"Line {i} holds ordinary{i} words like alpha{i} and beta{i} that end well."


RULED = {
    "good": "\n".join(map(line, range(5))), "null": None, "empty": "", "blank": " \n\t\n ", "eight": "a b c d e f g h",
    "menu": "\n".join(["home | news | about", "log in", "contact us"] * 12), "shout": "BUY!! NOW!! GO!! " * 30 + ".",
    "mixed": "\n".join([*map(line, range(4)), "Home", "cookie policy."]), "repeat": "one two three four five six seven eight nine. " * 9,
    "overlap": "a a a a a a a a a a a b c d e f g h i j k l m n o p", "é": "é😀 " * 30,
}


def test_numbers_are_no_letters():
    classify = langid.classifier({"xx": [b"the and of with this that from have"], "yy": [b"der die und mit das ist nicht ein"]})
    assert [classify(x)[0] for x in ("½ ²", "Ⅷ 12", "٣ _", "1a", "é")].count("und") == 3


def test_sizes_equal_plain_sums():
    """The winner is the language whose blocks, compressed one by one with every dictionary, take the fewest bytes."""
    import zstandard

    rng = __import__("random").Random(3)
    model = {lang: [" ".join(rng.choices(words, k=400)).encode() for _ in range(2)] for lang, words in {
        "xx": ["the", "and", "of", "with", "this"], "yy": ["der", "die", "und", "mit", "das"], "zz": ["le", "la", "et", "avec", "ce"]}.items()}
    classify = langid.classifier(model)
    for k in (3, 40, 4000):
        text = " ".join(rng.choices(["the", "der", "le", "and", "und"], k=k))
        sizes = {}
        for lang, shards in model.items():
            sizes[lang] = 0
            for raw in shards:
                z = zstandard.ZstdCompressor(
                    dict_data=zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT),
                    compression_params=zstandard.ZstdCompressionParameters(**langid.PARAMETERS))
                sizes[lang] += sum(len(z.compress(langid.PAD + b + b" ")) for b in langid.blocks(langid.letters(text)))
        assert classify(text)[0] == min(sorted(sizes), key=sizes.get)


def test_line_rules(spark):
    rows = [(k, v) for k, v in RULED.items()] + [("good", RULED["good"])]
    docs = spark.createDataFrame(rows, "doc_id string, text string").withColumn("kept", F.lit(7))
    for r in linerules.judge(docs).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_measures(RULED[r.doc_id]), r.doc_id
        assert r.kept == (r.doc_id in ("good", "mixed")), r.doc_id
    cleaned = {r.doc_id: r.text for r in linerules.clean(docs).collect()}
    assert cleaned["good"] == RULED["good"] and "Home" not in cleaned["mixed"] and "cookie" not in cleaned["mixed"]
    assert linerules.judge(docs.limit(0)).count() == 0
    named = docs.withColumns({"n_words": F.lit("mine"), "cleaned": F.lit("own"), "_lines": F.lit(1)})
    assert linerules.clean(named).columns == named.columns
    assert {(r.kept, r.n_words, r.cleaned, r._lines) for r in linerules.clean(named).collect()} == {(7, "mine", "own", 1)}


def test_line_rules_equal_their_statement(spark, tmp_path):
    """Also where texts hold the phrases, as words, inside words and in long lines."""
    import duckdb

    from fleetlens.llm.oracles import ORACLE
    from tools.check_oracle import compare

    rng = __import__("random").Random(8)
    phrases = ["Sign in", "read more", "lorem ipsum", "LOREM IPSUM", "blog in", "catalog in", "javascript", "JavaScript!", "log_in", "élog in", "log iné", "all rights reserved", "##", "!!"]
    lines = [" ".join(rng.choices(["word", "another", "thing", "$", *phrases], [6, 6, 6, 1, *[1] * len(phrases)], k=rng.randrange(1, 24))) + rng.choice([".", "", "?", ")", " ."]) for _ in range(400)]
    rows = [(i, "\n".join(rng.choices(lines, k=rng.randrange(0, 12)))) for i in range(150)] + [(200, None), (201, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    cursor = con.execute(ORACLE["op5_line_rules"])
    names = [d[0] for d in cursor.description]
    got = queries.op5_line_rules(spark, str(tmp_path)).select(*names)
    assert got.where("kept_chars > 0").count() > 20
    assert compare([tuple(r) for r in got.collect()], cursor.fetchall()) is None


def test_long_lines_may_mention_boilerplate_phrases(spark):
    essay = " ".join(f"Part {i} says why we design in{i} steps, blog in spring{i}, read more, share this{i} and have a privacy policy at {i}." for i in range(60))
    told = " ".join(f"Part {i} tells how to sign in{i} or sign in, click here{i}, log in or use javascript{i} or javascript without its privacy policy {i}." for i in range(60))
    rows = {"essay": essay, "told": told, "filler": told + " Lorem ipsum dolor.", "words": "\n".join(f"They{i} assign in a catalog{i} in dialog in turn." for i in range(5)),
            "menu": "\n".join([*map(line, range(4)), "Sign in.", "Please log in to read more!", "We like JavaScript."])}
    got = {r.doc_id: r for r in linerules.judge(spark.createDataFrame(list(rows.items()), "doc_id string, text string")).collect()}
    assert all(got[k].kept and got[k].cleaned == rows[k] for k in ("essay", "told", "words"))
    assert not got["filler"].kept and got["filler"].cleaned == ""
    assert got["menu"].kept and got["menu"].cleaned == "\n".join(map(line, range(4)))
