"""The queries opN_* against brute force, exact round trips or held-out accuracy, on the small tables."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import public_tokenizers

from fonotrama.llm import packing
from fonotrama.llm import queries as Q

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return [r.asDict() for r in spark.read.parquet(f"{SMALL}/documents.parquet").orderBy("doc_id").collect()]


def rows(df):
    return [r.asDict() for r in df.collect()]


def crc_mod(i, m):
    return zlib.crc32(str(i).encode()) % m


def test_language(spark):
    got = {r["doc_id"]: r for r in rows(Q.op1_language_id(spark, MIDDLE))}
    docs = rows(spark.read.parquet(f"{MIDDLE}/documents.parquet"))
    assert set(got) == {d["doc_id"] for d in docs}
    langs = {d["lang"] for d in docs if d["lang"]}
    right = []
    for d in docs:
        g = got[d["doc_id"]]
        assert g["held_out"] == (crc_mod(d["doc_id"], 4) == 2) and 0 <= g["score"] <= 1 and g["lang_pred"] in langs | {"und"}
        if g["held_out"] and d["lang"]:
            right.append(g["lang_pred"] == d["lang"])
    assert np.mean(right) > 0.95


def syncmers(t, k=16, s=6):
    import xxhash

    h = lambda x: (v := xxhash.xxh64(x.encode(), seed=42).intdigest()) - (v >> 63 << 64)
    at = []
    for i in range(len(t) - k + 1):
        inner = [h(t[j : j + s]) for j in range(i, i + k - s + 1)]
        if min(inner) in (inner[0], inner[-1]):
            at.append(i)
    return at


def test_fingerprints(spark, docs):
    from fonotrama.llm import syncmers as S

    got = {r["doc_id"]: r for r in rows(Q.op2_syncmer_fingerprints(spark, SMALL))}
    texts = [d["text"] or "" for d in docs]
    edited = [t[: len(t) - len(t) // 2] + texts[(i + 1) % len(texts)][: len(t) // 2] for i, t in enumerate(texts)]
    of = {r["doc_id"]: r["fingerprint"] for r in rows(S.fingerprints(spark.createDataFrame(list(enumerate(edited)), "doc_id long, text string")))}
    cut = lambda f: {f[i : i + 16] for i in range(0, len(f), 16)}
    signed = lambda x: int(x, 16) - (int(x, 16) >> 63 << 64)

    def near(a, b):
        least = set(sorted(cut(a) | cut(b), key=signed)[: S.SKETCH])
        return len(least & cut(a) & cut(b)) / len(least)

    for i, d in enumerate(docs):
        g = got[d["doc_id"]]
        assert g["n_chars"] == len(texts[i]) and g["edited_sha256"] == hashlib.sha256(edited[i].encode()).hexdigest()
        assert g["edited_fingerprint"] == of[i]
        assert g["near_edited"] == pytest.approx(near(g["fingerprint"], g["edited_fingerprint"]))
        assert g["near_next"] == pytest.approx(near(g["fingerprint"], got[docs[(i + 1) % len(docs)]["doc_id"]]["fingerprint"]))
    at: dict[int, list] = {}
    for r in rows(S.anchor_rows(spark.read.parquet(f"{SMALL}/documents.parquet").where("doc_id < 20"))):
        at.setdefault(r["doc_id"], []).append(r["at"])
    for d in docs:
        if d["doc_id"] < 20:
            assert sorted(at.get(d["doc_id"], [])) == syncmers(d["text"] or ""), d["doc_id"]


def test_chat(spark):
    turns = rows(spark.read.parquet(f"{SMALL}/conversations.parquet"))
    turns += [{"conv_id": -1, "turn": i, "role": r, "text": "</s>[INST] ok [/INST]"} for i, r in enumerate(("user", "assistant"))]
    by: dict[int, list] = {}
    for t in sorted(turns, key=lambda t: (t["conv_id"], t["turn"])):
        by.setdefault(t["conv_id"], []).append((t["role"], t["text"] or ""))
    got = {r["conv_id"]: r for r in rows(Q.op3_chat_round_trip(spark, SMALL))}
    assert set(got) == set(by)
    for c, ts in by.items():
        loss = "".join(x for r, x in ts if r == "assistant")
        want = (len(ts), hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in ts).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert tuple(got[c][k] for k in ("n_turns", "turns_sha256", "loss_chars", "loss_sha256")) == want
        assert got[c]["formatted_chars"] >= sum(len(x) for _, x in ts)


def bag(t):
    w = re.findall(r"[^\x20\x09-\x0d]+", "".join(c.lower() if c.isascii() else c for c in t))
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def brute_classes(docs, similar=0.8):
    bags = [bag(d["text"] or "") for d in docs]
    head = list(range(len(docs)))

    def find(i):
        while head[i] != i:
            i = head[i]
        return i

    texts = [d["text"] or "" for d in docs]
    sizes = [sum(b.values()) for b in bags]
    for i in range(len(docs)):
        for j in range(i):
            alike = texts[i] == texts[j]
            if not alike and sizes[i] and sizes[j] and min(sizes[i], sizes[j]) >= similar * max(sizes[i], sizes[j]) and find(i) != find(j):
                both = (bags[i] & bags[j]).total()
                alike = both / (sizes[i] + sizes[j] - both) >= similar
            if alike and (a := find(i)) != (b := find(j)):
                head[max(a, b)] = min(a, b)
    return {docs[i]["doc_id"]: docs[find(i)]["doc_id"] for i in range(len(docs))}


def test_near_duplicates(spark):
    docs = rows(spark.read.parquet(f"{MIDDLE}/documents.parquet").orderBy("doc_id"))
    want = brute_classes(docs)
    got = {r["doc_id"]: r["class_id"] for r in rows(Q.op4_near_duplicates(spark, MIDDLE))}
    assert set(got) == set(want)
    assert sum(want[d] != d for d in want) > 20
    assert got == want


def test_near_duplicates_of_a_template(spark):
    """Pairs of near copies within a family whose other members are alike by less than the threshold."""
    from fonotrama.llm import neardup as N

    rng = np.random.default_rng(11)
    word = lambda n: ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 7)) for _ in range(n)]
    common, family = word(140), 150
    texts = []
    for _ in range(family):
        own = word(22)
        texts.append((" ".join(common + own), " ".join(common + own[:-16] + word(16))))
    bags = [[N.shingles([t.encode()])[:2] for t in pair] for pair in texts[:20]]
    assert all(N.similarity(a, b) >= 0.8 for a, b in bags)
    assert all(0.6 < N.similarity(bags[i][x], bags[j][y]) < 0.8 for i in range(20) for j in range(i) for x in (0, 1) for y in (0, 1))
    docs = [(i + family * x, texts[i][x]) for i in range(family) for x in (0, 1)]
    got = {r["doc_id"]: r["class_id"] for r in rows(N.classes(spark.createDataFrame(docs, "doc_id long, text string")))}
    assert [i for i, _ in docs if got[i] != i % family] == []


def test_packing(spark, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    odd = [(-1, "a <|endoftext|> b"), (-2, "<|endoftext|><|endoftext|>x<|endoftext| >")]
    given = [(d["doc_id"], d["text"]) for d in docs] + odd
    df = spark.createDataFrame(given, "doc_id long, text string")
    docs = [{"doc_id": i, "text": x} for i, x in given]
    ids = {d["doc_id"]: e.ids + [2] for d, e in zip(docs, t.encode_batch([d["text"] or "" for d in docs], add_special_tokens=False), strict=True)}
    got = rows(packing.pack_documents(df, public_tokenizers.path("byte_bpe_50k.json")))
    shown = lambda rs: sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rs)
    assert shown(r for r in got if r["doc_id"] >= 0) == shown(rows(Q.op5_best_fit_packing(spark, SMALL)))
    assert ids[-1] == [64, 220, 50256, 275, 2]
    whole: dict[int, list] = {}
    for r in got:
        whole.setdefault(r["doc_id"], []).append(r)
    assert set(whole) == set(ids)
    for i, pieces in whole.items():
        pieces.sort(key=lambda r: r["piece"])
        assert [p["piece"] for p in pieces] == list(range(len(pieces)))
        at = 0
        for p in pieces:
            assert p["start"] == at and p["ids_crc32"] == zlib.crc32(np.array(ids[i][at : at + p["length"]], "<u4").tobytes())
            at += p["length"]
        assert at == len(ids[i]) and all(p["length"] == 1024 for p in pieces[1:]) and (len(pieces) == 1 or at > 1024)
    held: dict[int, list] = {}
    for r in got:
        held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in held.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 1024
    assert len(held) <= 1.01 * -(-sum(map(len, ids.values())) // 1024) + 1


def test_quality(spark):
    labels = {r["doc_id"]: r["quality"] for r in rows(spark.read.parquet(f"{MIDDLE}/labels.parquet"))}
    got = {r["doc_id"]: r for r in rows(Q.op6_quality(spark, MIDDLE))}
    assert all(0 <= g["score"] <= 1 for g in got.values())
    kept_bad = [got[d]["keep"] for d, q in labels.items() if q == 0 and d in got]
    kept_good = [got[d]["keep"] for d, q in labels.items() if q == 1 and d in got]
    assert np.mean(kept_good) > 0.99 and np.mean(kept_bad) < 0.05


def test_quality_learns_from_every_document(spark):
    """Each feature of any document has a weight, weights are a minimum over all documents, the threshold an order statistic of all."""
    from fonotrama.llm import quality

    rng = np.random.default_rng(5)
    words = "the of a storm and in harbour was it on lantern to that gate is kept by her old river".split()
    texts = [" ".join(rng.choice(words, int(n))) + "." for n in rng.integers(20, 50, 20_000)]
    for i in range(0, 20_000, 7):
        texts[i] = " ".join(f"{w} |" if j % 2 else f"{w} #" for j, w in enumerate(texts[i].split()))
    for i, odd in enumerate(("!!|", "|7#", '"#!', "7!7", "#7|", '!"|', "||7", '#"7', "7|!", "!#7")):
        texts[1501 * i + 1] += " " + odd
    texts += ["", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = quality.fit(df)
    made = [(m, quality.features(m, g), n) for m, g, n in map(quality.measure, texts[:20_000])]
    assert set(np.flatnonzero(got.weights)) == set(np.concatenate([f[0] for _, f, _ in made]).tolist())
    y = got.labels.posterior(np.array([quality.votes(m, n) for m, _, n in made]) + 1)
    z = np.array([got.weights[f[0]] @ f[1].astype(float) for _, f, _ in made]) + got.bias
    p, balance = 1 / (1 + np.exp(-z)), np.where(y >= 0.5, 1, min(5, max(1, (y >= 0.5).sum() / (y < 0.5).sum())))
    slope = 1e-5 * got.weights
    for d, (_, f, _) in zip((p - y) * balance / len(y), made, strict=True):
        np.add.at(slope, f[0], d * f[1])
    assert np.abs(slope).max() < 1.1e-4
    held = np.sort(p[y >= 0.5])
    assert got.threshold == pytest.approx(min(0.5, held[int(0.001 * len(held))]))
    again = quality.fit(df.repartition(2))
    assert (again.weights == got.weights).all() and (again.bias, again.threshold) == (got.bias, got.threshold)


def test_quality_order_statistic(spark):
    from pyspark.sql import functions as F

    from fonotrama.llm import quality

    values = np.random.default_rng(6).random(3000).round(3) / 2
    df = spark.createDataFrame([(int(b),) for b in values.view(np.int64)], "bits long")
    for k in (0, 1, 77, 1500, 2999):
        assert np.int64(quality.least(df, k)).view(np.float64) == np.sort(values)[k]
    assert quality.least(df, 3000) is None and quality.least(df.where(F.lit(False)), 0) is None


def test_byte_bpe(spark, docs):
    import base64

    import tiktoken

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r["doc_id"]: r for r in rows(Q.op7_byte_bpe(spark, SMALL))}
    for d in docs:
        ids = coder.encode_ordinary(d["text"] or "")
        want = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((d["text"] or "").encode()).hexdigest())
        assert tuple(got[d["doc_id"]][k] for k in ("n_tokens", "ids_sha256", "decoded_sha256")) == want


def test_neighbours(spark):
    vectors = {r["vec_id"]: np.array(r["embedding"], float) for r in rows(spark.read.parquet(f"{MIDDLE}/embeddings.parquet")) if r["embedding"] is not None}
    ids = np.array(sorted(vectors))
    v = np.stack([vectors[i] for i in ids])
    got: dict[int, list] = {}
    for r in rows(Q.op8_nearest_neighbours(spark, MIDDLE)):
        got.setdefault(r["query_id"], []).append(r)
    assert set(got) == {i for i in ids.tolist() if i % 20 == 0}
    found = []
    for q, rs in got.items():
        rs.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in rs] == list(range(1, 21)) and all(r["vec_id"] != q for r in rs)
        assert all(r["score"] == pytest.approx(float(vectors[q] @ vectors[r["vec_id"]]), abs=1e-12) for r in rs)
        assert [(-r["score"], r["vec_id"]) for r in rs] == sorted((-r["score"], r["vec_id"]) for r in rs)
        s = v @ vectors[q]
        s[ids == q] = -np.inf
        best = set(ids[np.argsort(-s, kind="stable")[:20]].tolist())
        found.append(len(best & {r["vec_id"] for r in rs}) / 20)
    assert np.mean(found) >= 0.9, np.mean(found)


def test_neighbours_in_pruned_lists(spark):
    """Recall where lists are pruned: clusters follow the ids, the first is tight, and norms vary."""
    from pyspark.sql import functions as F

    from fonotrama.llm import ann

    rng = np.random.default_rng(13)
    clusters, per, d = 20, 1000, 24
    centres = 0.5 * rng.normal(0, 1, (clusters, d))
    centres[0] *= 2 * np.sqrt(d) / np.linalg.norm(centres[0])
    spread = np.where(np.arange(clusters) == 0, 0.01, 1.0)
    v = np.repeat(centres, per, axis=0) + np.repeat(spread, per)[:, None] * rng.normal(0, 1, (clusters * per, d))
    v[per:] *= rng.uniform(0.5, 1, len(v) - per)[:, None]
    df = spark.createDataFrame(list(enumerate(v.tolist())), "vec_id long, embedding array<double>")
    got: dict[int, set] = {}
    for r in rows(ann.search(df, lambda i: F.pmod(i, F.lit(20)) == 0)):
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    found = np.zeros(clusters)
    for q in range(0, len(v), 20):
        s = v @ v[q]
        s[q] = -np.inf
        found[q // per] += len(got[q] & set(np.argsort(-s, kind="stable")[:20].tolist())) / 20 / (per // 20)
    assert found.mean() >= 0.9 and found.min() >= 0.8, found


def test_neighbourhoods_of_lists():
    """Groups are compact and hold about equal numbers of vectors; any number of lists and groups works."""
    from fonotrama.llm import ann

    rng = np.random.default_rng(3)
    points = np.repeat(rng.normal(0, 10, (8, 6)), 8, axis=0) + rng.normal(0, 0.1, (64, 6))
    sizes = rng.integers(200, 300, 64)
    group = ann.neighbourhoods(points, sizes, 8)
    held = np.bincount(group, sizes, 8)
    assert held.max() < 2 * held.min()
    assert np.mean([len(set(group[8 * i : 8 * i + 8].tolist())) for i in range(8)]) < 3
    for lists, groups in ((1, 16), (2, 16), (5, 16), (16, 1)):
        found = ann.neighbourhoods(np.zeros((lists, 3)), np.zeros(lists, np.int64), groups)
        assert len(found) == lists and found.min() >= 0 and found.max() < groups


def test_nearest_rows_of_a_block():
    """Against brute force: lists that are read, ties, ids in several rows, and more rows of one id than are looked at first."""
    from fonotrama.llm import ann

    rng = np.random.default_rng(5)
    v = rng.integers(-2, 3, (400, 3)).astype(float)
    ids = np.concatenate((np.full(150, 7), rng.integers(0, 120, 250)))
    v[:150] = 3 + rng.integers(0, 2, (150, 3))
    of, q, q_ids = rng.integers(0, 6, 400), rng.integers(1, 3, (9, 3)).astype(float), np.arange(0, 18, 2)
    lists = [sorted(rng.choice(9, 4, replace=False).tolist()) for _ in q]
    got = ann.nearest_rows(q, q_ids, lists, [ids, v, of], 5, 15)
    want = []
    for x, i, own in zip(q, q_ids.tolist(), lists, strict=True):
        best: dict = {}
        for j, y, c in zip(ids.tolist(), v, of.tolist(), strict=True):
            if c in own and j != i:
                best[j] = max(best.get(j, -np.inf), float(x @ y))
        want += [(i, j, s) for j, s in sorted(best.items(), key=lambda e: (-e[1], e[0]))[:5]]
    assert sorted(zip(*(g.tolist() for g in got), strict=True)) == sorted(want)


def test_secrets(spark):
    docs = rows(spark.read.parquet(f"{MIDDLE}/documents.parquet"))
    got = {r["doc_id"]: r for r in rows(Q.op9_secret_scan(spark, MIDDLE))}
    kinds = ("assign", "access", "hex", "network")
    assign = re.compile(r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.A)
    some = 0
    for d in docs:
        t = d["text"] or ""
        base = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 8]
        base += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
        base += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
        say = [f"{kinds[k]}:{a}:{b}" for a, k, b in sorted(base)]
        g = got[d["doc_id"]]
        assert g["base_sha256"] == hashlib.sha256(",".join(say).encode()).hexdigest()
        assert set(say) <= set(g["spans"].split(",")) | {""} and [g[f"n_{k}"] for k in kinds[:3]] == [sum(x == k for _, x, _ in base) for k in range(3)]
        some += bool(base)
    assert some > 5


def test_secrets_threshold_and_parts():
    from fonotrama.llm import secretscan as S

    rng = np.random.default_rng(17)
    net = S.CharNet.start(rng)
    made = [S.made_up(rng, k, ["some", "plain", "words"]) for k in range(640)]
    x, y = S.codes([S.windows(t, 0, len(t))[0] for t, _ in made]), np.array([s for _, s in made], float)
    net.calibrate(x, y)  # an untrained network is unsure
    found = net.probability(x) >= net.threshold
    assert found[y > 0].mean() >= S.RECALL and net.recall == found[y > 0].mean() and net.precision == y[found].mean()
    net.threshold = 0.0
    rest, left, right = "wJalrXUtnFEMIK7MDENGbPxRfiCYEXAMPLEKEY", "Zq9XvT4LmR8sWp2KyB", "Hn7GcD3JtF6xUz5QeVw"
    text = f"a AKIA{'Q7' * 8}/{rest} b {left}{'0f' * 16}{right} c"
    spans = S.spans_of([text], net)[0]
    clean = S.redact_text(text, spans)
    assert not any(k in clean for k in (rest, left, right)) and spans == sorted(spans)
    assert all(a[2] <= b[0] for a, b in zip(spans, spans[1:], strict=False))


def test_secrets_that_rules_miss(spark):
    """Strings of formats that the fit has and has not seen, without a keyword, among plain long tokens of the same texts."""
    from fonotrama.llm import secretscan as S

    rng = np.random.default_rng(23)
    docs = rows(spark.read.parquet(f"{MIDDLE}/documents.parquet"))
    net = S.fit(spark.read.parquet(f"{MIDDLE}/documents.parquet"))
    assert net.recall >= S.RECALL
    draw = lambda letters, n: "".join(letters[i] for i in rng.integers(0, len(letters), n))
    alnum = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    known = [lambda: "ghp_" + draw(alnum, 36), lambda: "sk_live_" + draw(alnum, 24), lambda: draw(alnum + "+/", 44)]
    new = [lambda: "glpat-" + draw(alnum + "_-", 20), lambda: "npm_" + draw(alnum, 36), lambda: "dckr_pat_" + draw(alnum, 27)]
    plain = [lambda: "-".join(draw("aeioulnrst", 6) for _ in range(4)), lambda: draw("0123456789", 18), lambda: "src/" + "/".join(draw("aeioulnrst", 5) for _ in range(4)), lambda: draw("aeioulnrst", 22)]
    found = {}
    for name, kinds in (("known", known), ("new", new), ("plain", plain)):
        texts, places = [], []
        for k in range(150):
            words = (docs[k]["text"] or "").split()[:40]
            s, at = kinds[k % len(kinds)](), len(words) // 2
            head = " ".join(words[:at]) + " "
            texts.append(head + s + " " + " ".join(words[at:]))
            places.append((len(head), len(head) + len(s)))
        spans = S.spans_of(texts, net)
        found[name] = np.mean([any(k == 3 and a < y and x < b for a, k, b in got) for got, (x, y) in zip(spans, places, strict=True)])
    assert found["known"] >= 0.9 and found["new"] >= 0.75 and found["plain"] <= 0.05, found


def test_language_model(spark, docs):
    lower = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    tok = {d["doc_id"]: [*re.findall(r"[^\x20\x09-\x0d]+", lower(d["text"] or "")), None] for d in docs}
    c = Counter(x for i, ts in tok.items() if crc_mod(i, 5) != 1 for x in ts)
    n, v = c.total(), len(c)
    base, full = 0.0, 0.0
    got = {r["doc_id"]: r for r in rows(Q.op10_language_model(spark, SMALL))}
    for i, ts in tok.items():
        g = got[i]
        want = sum(np.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in ts)
        assert g["base_score"] == pytest.approx(want, rel=1e-9) and (g["n_tokens"], g["n_known"], g["train_tokens"]) == (len(ts), sum(c[x] > 0 for x in ts), n)
        assert g["held_out"] == (crc_mod(i, 5) == 1)
        if g["held_out"]:
            base, full = base + g["base_score"], full + g["score"]
    assert full > base


def test_language_model_by_hand(spark):
    """Scores of a small table, cut into chunks inside texts, against sums over digits and leaves written out."""
    from pyspark.sql import functions as F

    from fonotrama.llm import common as C
    from fonotrama.llm import maxent as M

    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abcde"), 3)) for _ in range(60)]
    texts = [" ".join(words[int(60 * x * x)] for x in rng.random(int(n))) for n in rng.integers(0, 400, 80)] + ["Aaa  unheard\tof", None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    before = dict(spark.sparkContext.getConf().getAll()) | {k: spark.conf.get(k) for k in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize")}
    held = C.is_fold("doc_id", 5, 1)
    chunks, counted, model = M.fitted(df, held, "doc_id", "text")
    assert before == before | {k: spark.conf.get(k) for k in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize")}
    assert model.weights.any() and model.digits == 0 or len(model.leaves[15]) == 16**model.digits
    got = {r["doc_id"]: r["score"] for r in rows(M.score(df, held))}
    tok = [[*re.findall(r"[^\x20\x09-\x0d]+", (t or "").lower()), None] for t in texts]
    seen = Counter(x for i, ts in enumerate(tok) if crc_mod(i, 5) != 1 for x in ts)
    code_of = lambda x: int(M.END) if x is None else int(C.hash_words([x.encode()])[0][0])
    head = [x for x, _ in sorted(seen.items(), key=lambda e: (-e[1], code_of(e[0]) - (code_of(e[0]) >> 63 << 64)))][: M.HEAD]
    mass = sum(seen[x] for x in head[M.SINGLE :])
    kind, run = {}, 0
    for k, x in enumerate(head):
        kind[x] = k if k < M.SINGLE else M.SINGLE + min(6, int(run / mass * 7))
        run += seen[x] if k >= M.SINGLE else 0
    word = lambda x: (1 << 64) - 1 & x

    def mix(x):
        x = word((x ^ x >> 30) * 0xBF58476D1CE4E5B9)
        x = word((x ^ x >> 27) * 0x94D049BB133111EB)
        return x ^ x >> 31

    seeds = [int(x) for x in M._SEEDS]

    def digits(x):
        d = 0 if kind.get(x, 15) < M.SINGLE else min(M.HEAD_DIGITS, model.digits) if x in kind else model.digits
        return [mix(code_of(x) ^ seeds[0]) >> 60 - 4 * j & 15 for j in range(d)]

    leaf = lambda x: (kind.get(x, 15), *digits(x))
    leaves: dict = {}
    for x in seen:
        leaves[leaf(x)] = leaves.get(leaf(x), 0) + seen[x] + 0.5
    grid = [()]
    for _ in range(model.digits):
        grid = [(*g, j) for g in grid for j in range(16)]
    for g in grid:
        leaves[(15, *g)] = leaves.get((15, *g), 0) + 0.5
    w, n_rows = model.weights.astype(float), len(model.weights)

    def chance(x, back):
        b = [code_of(back[-k]) if len(back) >= k else k for k in (1, 2, 3)]
        out, path = 0.0, leaf(x)
        for k, digit in enumerate(path):
            z = np.array([np.log(sum(v for p, v in leaves.items() if p[: k + 1] == (*path[:k], j)) + 1e-9) for j in range(16)])
            if k == 0:
                f = [b[0] * seeds[0], b[0] * seeds[1] + b[1] * seeds[2], b[1] * seeds[3] + 7, b[2] * seeds[4] + 9]
            else:
                node = int(model.first_node[path[0], k - 1]) + sum(j << 4 * (k - 2 - i) for i, j in enumerate(path[1:k]))
                mark = mix(word(node + seeds[6]))
                f = [mark + b[0] * seeds[5]]
            z += sum(w[mix(word(x)) & n_rows - 1] for x in f)
            out += z[digit] - np.log(np.exp(z).sum())
        return out + (np.log((seen[x] + 0.5) / leaves[path]) if path[0] >= M.SINGLE else 0.0)

    for i in (0, 7, 33, 80, 81, 82):
        want = sum(chance(x, tok[i][:k]) for k, x in enumerate(tok[i])) / np.log(10)
        assert got[i] == pytest.approx(want, rel=2e-4, abs=1e-4), i
    assert sum(np.exp(chance(x, tok[7][:2])) for x in seen) <= 1 + 1e-4
    whole = {r["doc_id"]: r for r in rows(M.packed(df, held).select(F.explode("ids").alias("doc_id")))}
    cut = M.packed(df.coalesce(1), held, size=300)
    assert cut.count() > 40 and set(whole) == {r["i"] for r in rows(cut.select(F.explode("ids").alias("i")))}
    heard: dict = {}
    for r in sorted(rows(cut), key=lambda r: r["chunk"]):
        r, h, at, sizes = M.read(r)
        hs, lo = h[at][r["skip"] :].tolist(), 0
        if r["skip"]:
            assert heard[r["ids"][0]][-r["skip"] :] == h[at][: r["skip"]].tolist()
        for i, n in zip(r["ids"], [sizes[0] - r["skip"], *sizes[1:]], strict=True):
            heard.setdefault(i, []).extend(hs[lo : lo + n])
            lo += n
    assert heard == {i: [code_of(x) for x in ts] for i, ts in enumerate(tok)}
