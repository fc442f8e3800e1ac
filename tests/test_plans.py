import json
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from fonotrama import queries as Q
from fonotrama.functions import normalise
from fonotrama.operators import compare, mining
from fonotrama.plans import phonemes as P
from fonotrama.sources import corpora
from fonotrama.sources import lexicons as L
from fonotrama.streaming import service as S


@pytest.fixture(scope="module")
def seed(spark):
    return P.Dictionaries(**L.seed(spark))


def said(spark, seed, *texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {i: [] for i in range(len(texts))}
    for r in P.phonemise(rows, seed).orderBy("doc", "sent").collect():
        out[r.doc].append(r.ipa)
    return [" ".join(out[i]) for i in range(len(texts))]


def test_phrases(spark, seed):
    got = said(spark, seed, "de", "de casa", "para casa", "ser algo", "que", "na", "As coisas", "Muitas vezes Os animais", "casa", "guarda-chuva novo", "Olá, mundo.", "", None)
    assert got[0] == "dʒˈy" and "dʒy" in got[1] and "pˌaɾæ" in got[2] and "seɾ" in got[3] and got[4] == "kˈy" and got[5] == "nˈa"
    assert "as kˈoɪzæs" in got[6] and len(got[7].split()) == 4 and got[8] == "kˈazæ" and len(got[9].split()) == 3
    assert "," in got[10] and got[10].endswith(".") and got[11] == "" and got[12] == ""


def test_initials(spark):
    rows = spark.createDataFrame([(0, 0, "as casas, azuis de ouro")], "doc long, sent int, sentence string")
    got = {r.token: r.initial for r in P.with_context(P.token_rows(rows)).where("kind = 'word'").collect()}
    assert got == {"as": "c", "casas": None, "azuis": "d", "de": "o", "ouro": None}
    odd = spark.createDataFrame([(0, 0, "os - amigos dele")], "doc long, sent int, sentence string")
    drift = {r.token: r.initial for r in P.with_context(P.token_rows(odd)).where("kind = 'word'").collect()}
    plain = {r.token: r.initial for r in P.with_context(P.token_rows(odd), strict_compat=False).where("kind = 'word'").collect()}
    assert plain == {"os": "a", "amigos": "d", "dele": None} and drift == {"os": "a", "amigos": None, "dele": None}


def test_senses(spark, seed):
    from dataclasses import replace

    graphs = spark.createDataFrame([("sede", "water", "sˈedʒy"), ("sede", "seat", "sˈɛdʒy")], "word string, sense string, ipa string")
    tagged = spark.createDataFrame([(0, 0, 1, "sede", "water"), (0, 0, 4, "sede", "seat")], "doc long, sent int, pos int, word string, sense string")
    rows = spark.createDataFrame([(0, "a sede na sede")], "doc_id long, text string")
    got = P.phonemise(rows, replace(seed, homographs=graphs, checked={}), tagged=tagged).first().ipa
    assert "sˈedʒy" in got and "sˈɛdʒy" in got


def test_layers_and_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"lexico": {"casa": "x"}, "cliticos": {"de": "y"}}), encoding="utf-8")
    (tmp_path / "flat.json").write_text('{"sol": "s"}', encoding="utf-8")
    (tmp_path / "bad.json").write_text('{"sol": 3, "lua": [1]}', encoding="utf-8")
    (tmp_path / "h.json").write_text('{"sede": {"a": {"ipa": "i", "confianca": 0.5, "ocorrencias": 3}}}', encoding="utf-8")
    word, clitic = L.curated(spark, str(tmp_path / "a.json"), "lexico", "cliticos")
    assert word.collect() == [("casa", "x")] and clitic.collect() == [("de", "y")]
    assert L.first_filled(spark, [str(tmp_path / "none.json"), str(tmp_path / "flat.json")]).collect() == [("sol", "s")]
    assert L.homographs(spark, str(tmp_path / "h.json")).collect() == [("sede", "a", "i", 0.5, 3)]
    assert L.flat(spark, str(tmp_path / "none.json")).isEmpty()


def test_lookup_order(monkeypatch, tmp_path):
    monkeypatch.chdir(tmp_path)
    monkeypatch.setenv("FONOTRAMA_LEXICO", "hdfs:///shared/lexico.json")
    here = f"file://{tmp_path}"
    assert L.lookup_paths("lexico", "/opt/program") == ["hdfs:///shared/lexico.json", "file:///opt/program/lexico.json", *(f"{here}{d}/lexico.json" for d in ("", "/data", "/cache"))]
    monkeypatch.delenv("FONOTRAMA_LEXICO")
    assert L.lookup_paths("lexico")[0] == f"{here}/lexico.json"


def test_sentence_sql():
    """The SQL cuts odd texts where the splitter does."""
    texts = [
        "O Sr. Silva chegou. Depois saiu!", "Fim.\n\n\nNovo", "a.b.c. D. E", "Ver p. 3. Outra", "Ele disse \"oi.\" Ela riu", "Que?! Sim... não. Não", "x\r\n\r\ny", "", "  ", "...", "Fim.\u00a0Outro. \u2003Ponto. 9 casas",
        "a." * 90 + " B", "Dra. Ana (av. Brasil). (Talvez.) 'Sim.' Ok", "º. Um º. ªb. Ç. D", "\n.\n\n.\n", "Olá…» Bem … fim", "Sáb. Dom. Hoje.", "Não. \x1cSim. \x0bJá.",
    ]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [*enumerate(texts), (99, None)])
    want = [(i, k, x) for i, t in enumerate(texts) for k, x in enumerate(normalise.sentences(t))]
    assert sorted(con.execute(Q.SQL["sentence_split"]).fetchall()) == want


def test_corpora(spark, tmp_path):
    (tmp_path / "c.txt").write_text(" um \n\ndois\n", encoding="utf-8")
    assert [r.sentence for r in corpora.lines(spark, str(tmp_path / "c.txt")).collect()] == ["um", "dois"]
    assert len(corpora.whole_texts(spark, str(tmp_path / "c.txt")).first().digest) == 16
    (tmp_path / "e.jsonl").write_text('{"word":"a","sense":"b","sentence":"c"}\n{bad\n{"word":"a"}\n', encoding="utf-8")
    assert corpora.examples(spark, str(tmp_path / "e.jsonl")).count() == 1
    (tmp_path / "k1.json").write_text('{"sentencas":["a","b"],"espeak":["x","y"]}', encoding="utf-8")
    (tmp_path / "k2.json").write_text('{"a":"x"}', encoding="utf-8")
    assert sorted(map(tuple, corpora.cache(spark, str(tmp_path / "k1.json")).collect())) == [("a", "x"), ("b", "y")]
    held = corpora.cache(spark, str(tmp_path / "k2.json"))
    assert held.collect() == [("a", "x")] and corpora.cache_is_valid(held, held, "sentence") and corpora.cache_is_same(held, held)
    corpora.save(held, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_service(spark, seed, tmp_path):
    (tmp_path / "base.json").write_text('{"sol": "BASE", "mar": "MAR"}', encoding="utf-8")
    (tmp_path / "voice.json").write_text('{"sol": "VOICE"}', encoding="utf-8")
    lines = [
        {"action": "version"}, {"action": "set_lexicon", "base_path": str(tmp_path / "base.json"), "voice_paths": {"ana": str(tmp_path / "voice.json")}}, {"action": "process", "text": "A casa. O sol!"},
        {"action": "process_piper", "text": "sol"}, {"action": "process_piper_chunks", "text": "sol, mar."}, {"action": "process_batch", "words": ["sol", "sol", "lua", "kg"], "voice": "ana"},
        {"action": "process_batch", "words": ["sol"], "overrides": {"sol": "MINE"}}, {"action": "nothing"}, {"action": "process"},
    ]
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "one.txt").write_text("\n".join([*map(json.dumps, lines), "", "{oops"]) + "\n", encoding="utf-8")
    stream = S.serve(S.Service(spark, seed), S.json_lines(spark, str(folder)), S.write_lines(str(tmp_path / "out")), str(tmp_path / "ck"))
    stream.processAllAvailable()
    stream.stop()
    got = [json.loads(x) for p in sorted(Path(tmp_path / "out/batch=0").glob("part*")) for x in p.read_text(encoding="utf-8").splitlines()]
    assert len(got) == 10
    by = lambda k: [g for g in got if k in g]
    assert by("build") and by("ok") and len(by("error")) == 2
    assert [[s["text"] for s in g["sentences"]] for g in by("sentences")][0] == ["A casa.", "O sol!"]
    assert by("sentences")[1]["sentences"][0]["phonemes"] == list("BASE") and by("sentences")[2] == {"sentences": []}
    assert by("chunks")[0]["chunks"][0]["fragments"][0] == {"ipa": "BASE", "punct": ","}
    batch = by("phonemes")
    assert batch[0]["total"] == 4 and batch[0]["phonemes"]["sol"] == "VOICE" and set(batch[0]["phonemes"]) == {"sol", "lua", "kg"} and batch[1]["phonemes"] == {"sol": "MINE"}


def test_approximate_alignment():
    assert mining._share(["a", "b"], ["x", "y"]) == [("a", "x"), ("b", "y")]
    assert mining._share(["abc", "d"], ["x", "y", "z"]) == [("abc", "xy"), ("d", "z")]
    assert mining._share(["a", "b", "c"], ["x", "y"]) == [("c", "y")]
    assert mining._share(["a"], ["x", "y", "z"]) is None and mining._share([], ["x"]) is None


def test_ties_go_to_the_first_seen(spark):
    rows = spark.createDataFrame([(1, "w", "b"), (2, "w", "a"), (3, "w", "a"), (4, "w", "b")], "id long, word string, ipa string")
    assert mining.modal(rows, ["word"], "ipa", ["id"]).collect() == [("w", "b", 2, 4, 2)]


def test_null_outputs(spark):
    rows = spark.createDataFrame([(1, "a b", "x y", None), (2, "a b", "x y", "x z"), (3, "a", "x", "x y"), (4, None, None, None)], "sent_id long, sentence string, ipa_a string, ipa_b string")
    assert compare.aligned_summary(rows).collect() == [(2, 1, 1)]
    assert {r.errors: r.sentences for r in compare.errors_by_sentence(rows).collect()} == {"0": 3, "1": 1}
    assert compare.aligned_summary(rows.limit(0)).collect() == [(0, 0, 0)]


@pytest.fixture(scope="module")
def con(sf_dir):
    held = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        held.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return held


def shown(rows):
    return sorted(tuple("null" if v is None or v != v else f"{v:.7g}" if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", Q.QUERIES)
def test_query(spark, sf_dir, con, name):
    df = Q.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    rows = df.select(*[F.col(c) for c in columns]).collect()
    assert rows
    if name in Q.SQL:
        want = con.execute(f"SELECT {', '.join(columns)} FROM ({Q.SQL[name]})").fetchall()
        assert shown(rows) == shown(want)
