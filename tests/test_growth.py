"""Plans whose cost must grow no faster than the input: what an explosion carries, what is sorted, what a window frames."""

import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fonotrama import queries as Q
from fonotrama.operators import compare, mining
from fonotrama.plans import phonemes as P


def plan(df, kind="executedPlan"):
    return getattr(df._jdf.queryExecution(), kind)().toString()


def lines(df, *found):
    return [x for x in plan(df).splitlines() if any(f in x for f in found)]


@pytest.fixture(scope="module")
def outputs(spark):
    rows = [(3, "A casa é bela", "a kaza ɛ bɛla", "a kaza e bɛlɐ"), (1, "o sol", "u sɔl", "o sɔw"), (2, "um dois", "ũ dois", "ũ"), (4, None, None, "x"), (None, "mar alto", "mar awto", "maɾ awtu"), (5, "", "", "")]
    return spark.createDataFrame(rows, "sent_id long, sentence string, ipa_a string, ipa_b string")


def test_no_token_carries_its_sentence(outputs):
    for df in (compare.aligned(outputs), compare.aligned(outputs, around=True)):
        assert lines(df, "Generate") and not any("tt#" in x or "ta#" in x for x in lines(df, "Generate"))


def test_words_around(outputs):
    got = {(r.sent_id, r.pos): (r.anterior, r.word, r.proxima, r.total) for r in compare.aligned(outputs, around=True).collect()}
    assert got[3, 0] == (None, "a", "casa", 4) and got[3, 3] == ("é", "bela", None, 4) and got[None, 1] == ("mar", "alto", None, 2) and len(got) == 8
    more = outputs.sparkSession.createDataFrame([(1, "só", "a b c", "a b d")], outputs.schema)
    assert [(r.anterior, r.word, r.proxima) for r in compare.aligned(more, around=True).orderBy("pos").collect()] == [(None, "só", "[1]"), ("só", "[1]", "[2]"), ("[1]", "[2]", None)]


def test_categories_rank_counts_only(outputs):
    """All differences were sorted to find three examples of each category; now counts are, and a few sentences' differences."""
    df = compare.categories(outputs)
    got = {r.category: (r.n, r.examples) for r in df.collect()}
    assert got == {"1-char-diff": (6, "mar,alto,o")}
    assert any("pos#" not in x for x in lines(df, "WindowGroupLimit"))


@pytest.mark.parametrize("name", ["rules_consolidated", "rules_ranked", "rule_mining", "word_variation", "word_corrections", "divergence_pairs", "worst_words", "context_lexicon", "context_lexicon_pairs", "homograph_accuracy", "label_cooccurrence"])
def test_occurrences_are_counted_without_a_sort(spark, sf_dir, name):
    """Below the first exchange of counts, rows are hashed: a least struct made Spark sort every occurrence, and windows exchanged them."""
    found = plan(Q.QUERIES[name](spark, sf_dir)).splitlines()
    scan = next(i for i, x in enumerate(found) if "FileScan" in x and "documents" in x)
    below = found[max(i for i, x in enumerate(found[:scan]) if "Exchange hashpartitioning" in x) : scan]
    assert any("Generate" in x for x in below) and any("HashAggregate" in x for x in below) and not any("Sort" in x or "Window" in x for x in below)
    assert not any("tt#" in x or "pairs#" in x for x in below if "Generate" in x)


def test_places_of_any_size(spark):
    """The first of (id, pos) is the least, for ids that are null, negative or large too."""
    rows = spark.createDataFrame([(5, 1, "a"), (5, 0, "b"), (-(2**63), 3, "c"), (2**63 - 1, 0, "d"), (None, 7, "e"), (2**32, 0, "f"), (2**32 - 1, 2**31 - 1, "g")], "sent_id long, pos int, word string")
    got = [r.word for r in mining.counted(rows, ["word"], ["sent_id", "pos"]).orderBy("first").collect()]
    assert got == [r.word for r in rows.orderBy("sent_id", "pos").collect()] == list("ecbagfd")


@pytest.mark.parametrize("name", ["next_initial", "sandhi", "lexicon_resolve", "phonemise", "speech_chunks"])
def test_a_long_sentence_costs_its_length(spark, sf_dir, name):
    """A frame from each word to the end of its sentence, or a word's row that carries a list, cost the square of the length."""
    df = Q.QUERIES[name](spark, sf_dir)
    held = [m[1] for x in lines(df, "Generate") if (m := re.search(r"\[([^\[\]]*)\], (?:true|false), \[", x))]
    assert not lines(df, "Window") and not any(x.split("#")[0] in ("w", "t", "x") for h in held for x in h.split(", "))


def test_context_of_a_long_sentence(spark):
    text = "os - amigos, 'as ideias-mestras. -- e " * 3 + "mais"
    rows = spark.createDataFrame([(0, 0, text), (1, 0, "..."), (2, 0, "")], "doc long, sent int, sentence string")
    for strict in (True, False):
        want = [(r.token, r.initial, r.n_words) for r in P.with_context(P.token_rows(rows), strict).where("kind = 'word'").orderBy("doc", "pos").collect()]
        got = [(r.token, r.initial, r.n_words) for r in P.word_rows(rows, strict).orderBy("doc", "pos").collect()]
        assert got == want and len(got) == 16
    assert [x[1] for x in got[:5]] == ["a", None, "i", None, "o"]
    assert sorted((r.doc, r.n_words) for r in P.word_rows(rows, whole=True).where("rest IS NOT NULL").collect()) == [(0, 16), (1, 0), (2, 0)]


def test_alignment_holds_few_sentences_in_python():
    batch = pa.RecordBatch.from_pydict({"sent_id": list(range(100)), "w": [["a", "b"]] * 99 + [None], "s": [["x", "y"]] * 50 + [["x", "y", "z"]] * 49 + [[]]})
    got = [b.num_rows for b in mining._shares(iter([batch]))]
    assert sum(got) == 198 and max(got) <= 2 * mining.SLICE


def test_a_sentence_is_joined_once_for_all_its_examples(spark, sf_dir):
    examples = spark.createDataFrame([("sol", "a", "O sol e o Sol"), ("o", "b", "O sol e o Sol"), ("lua", "c", "O sol e o Sol"), ("sol", "a", "sol"), ("sol", "a", "sol dois")], "word string, sense string, sentence string")
    cached = spark.createDataFrame([("O sol e o Sol", "u sɔw i u sɔl"), ("sol", "sɔw"), ("sol dois", "sɔl"), ("sem", "x")], "sentence string, ipa string")
    df = mining.homograph_lexicon(examples, cached, least=1)
    assert sorted(map(tuple, df.collect())) == [("o", "b", "u", 1.0, 1), ("sol", "a", "sɔʊ", 1.0, 2)]
    join = next(i for i, x in enumerate(plan(df).splitlines()) if "Join" in x)
    assert any("collect_list" in x for x in plan(df).splitlines()[join:])


def test_speech_is_worked_out_at_most_twice(spark, sf_dir):
    """Once for the filter and once for the chunks; every branch of the chunks had worked it out again."""
    assert plan(Q.chunk_packing(spark, sf_dir), "optimizedPlan").count("\\([^)]*") <= 2


def test_categories_align_all_texts_once(outputs):
    """Totals and the first sentences come from one exchange of counts."""
    df = compare.categories(outputs)
    df.collect()
    assert sum("ReusedExchange" in x for x in plan(df).split("Initial Plan")[0].splitlines()) >= 1
