"""Each query function on a small folder of hard rows: null ids, null, empty and very long texts, repeated rows, ties, columns of clashing names."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash

from tempora.llm import registry

CLASH = "score double, accepted boolean, fp long, component_id long, key long, n long, ids string, lines_deleted long, range int"


def texts() -> list:
    rng = random.Random(7)
    words = {"en": "the quick brown fox jumps over lazy dogs while people walk".split(), "fr": "le chat noir dort sous la petite table pendant que nous parlons".split()}
    out = [(None, None), ("", "en"), ("  \t ", "fr"), ("42 !!", None), ("日本 é😀 \x1c", None)]
    for i in range(60):
        lang = "en" if i % 2 else "fr"
        out.append(("\n".join(" ".join(rng.choice(words[lang]) for _ in range(9)) for _ in range(1 + i % 5)), lang))
    out += [out[6], out[6], (out[7][0] + " more", "en")]
    out.append((" ".join(rng.choice(words["en"]) for _ in range(20000)), "en"))
    return out


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("contract"))
    clash = (0.5, True, 1, 2, 3, 4, "x", 5, 6)
    rows = [(i, t, lang, f"s{i % 3}", len(t or "")) for i, (t, lang) in enumerate(texts())]
    rows += [rows[9], rows[9], (None, "an unnamed text of the quick brown fox", "en", None, 5), (None, None, None, None, None)]
    spark.createDataFrame([(*r, *clash) for r in rows], f"doc_id long, text string, lang string, source string, n_chars long, {CLASH}").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 9 == 0)) for i in range(60)] + [(3, None, None), (None, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    pages = [
        (1, "http://a.net/x", '<link rel="canonical" href="http://b.com/de/1">'), (2, "http://c.net/", '<META http-equiv=refresh content="0; URL=/x2">'), (3, "http://c.net/x2", "<link href='//a.net/x#f' rel=canonical>"),
        (4, "https://z.com/fr/q", "<link rel=canonical href=http://a.net/x>"), (5, None, None), (6, "no url", ""), (7, "HTTP://WWW.Example.ORG/es/1?q#f", None), (8, "http://other.net/", ""), (8, "http://other.net/", ""), (None, "http://b.com/de/2", ""),
    ]
    spark.createDataFrame([(*p, "x", "y") for p in pages], "page_id long, url string, html string, host string, verdict string").write.parquet(f"{at}/pages.parquet")
    rng = np.random.default_rng(3)
    x = rng.standard_normal((90, 64))
    x = np.concatenate([x, x[:60] + 0.2 * rng.standard_normal((60, 64)), x[:30] * 3e150, x[:10]])
    vectors = [(i, v.tolist(), int(i % 3), 0) for i, v in enumerate(x)] + [(0, x[1].tolist(), 1, 0), (None, x[0].tolist(), 0, 0), (901, None, 1, 0), (902, [0.0] * 64, 1, 0), (903, [float("inf")] * 64, 1, 0), (904, x[0].tolist(), None, 0), (905, [1.0, None], 1, 0)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<double>, label int, node long").write.parquet(f"{at}/embeddings.parquet")
    return at


@pytest.fixture(scope="module")
def emptied(spark, folder, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("empty"))
    for t in ("documents", "labels", "pages", "embeddings"):
        spark.read.parquet(f"{folder}/{t}.parquet").limit(0).write.parquet(f"{at}/{t}.parquet")
    return at


def documents(spark, folder):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]


def multiset(rows):
    return sorted(map(repr, rows))


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_empty_tables(spark, emptied, name):
    assert registry.queries()[name](spark, emptied).count() == 0


def test_urls(spark, folder):
    got = [(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in registry.queries()["op1_url_aliases"](spark, folder).collect()]
    assert multiset(got) == multiset([
        (1, "a.net", "/x", None, "block"), (2, "c.net", "/", None, "block"), (3, "c.net", "/x2", None, "block"), (4, "z.com", "/fr/q", "com/fr/", "allow"), (5, "", "", None, "allow"), (6, "", "", None, "allow"),
        (7, "www.example.org", "/es/1", "example.org/es/", "block"), (8, "other.net", "/", None, "allow"), (8, "other.net", "/", None, "allow"), (None, "b.com", "/de/2", "com/de/", "block"),
    ])


def test_lines(spark, folder):
    got = registry.queries()["op2_line_runs"](spark, folder).collect()
    docs = {}  # rows that repeat id and text are one document; corpus order is id, null first
    for d, t in documents(spark, folder):
        docs[d, t] = t
    order = sorted((k for k in docs if k[1] is not None), key=lambda k: -1 if k[0] is None else k[0])
    seen, want = set(), {(d, t): (0, None) for d, t in docs if t is None}
    for k in order:
        ls, gone = k[1].split("\n"), set()
        for a in range(len(ls)):
            for n in range(1, 5):
                run = tuple(ls[a : a + n])
                if len(run) == n:
                    if run in seen and (n == 4 or sum(len(x.split()) for x in run) >= 8):
                        gone |= set(range(a, a + n))
                    seen.add(run)
        want[k] = (len(gone), hashlib.md5("\n".join(x for j, x in enumerate(ls) if j not in gone).encode()).hexdigest())
    assert multiset((r["doc_id"], r["lines_deleted"], r["kept_md5"]) for r in got) == multiset((d, *want[d, t]) for d, t in documents(spark, folder))


def test_packing(spark, folder):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = registry.queries()["op3_curve_packing"](spark, folder).orderBy("sequence_id", "offset").collect()
    at = 0
    for r in got:
        assert r["sequence_id"] * 1024 + r["offset"] == at and r["offset"] + r["length"] <= 1024
        at += r["length"]
    # a document's pieces follow each other, so the run of rows from start 0 to doc_tokens is one document
    docs, ids = [], {repr((d, t)): np.array([*lib.encode(t or "", add_special_tokens=False).ids, 0], "<u4").tobytes() for d, t in documents(spark, folder)}
    for r in got:
        if r["start"] == 0:
            docs.append([])
        assert sum(x["length"] for x in docs[-1]) == r["start"]
        docs[-1].append(r)
    have = [(d[0]["doc_id"], d[0]["doc_tokens"], [(x["start"], x["length"], x["ids_crc32"]) for x in d]) for d in docs]
    left = [(d, ids[repr((d, t))]) for d, t in documents(spark, folder)]
    assert len(have) == len(left)
    for doc, n, pieces in have:
        match = next(i for i, (d, raw) in enumerate(left) if d == doc and len(raw) == 4 * n and all(zlib.crc32(raw[4 * s : 4 * (s + k)]) == c for s, k, c in pieces))
        left.pop(match)


def test_languages(spark, folder):
    got = registry.queries()["op4_kn_language"](spark, folder).collect()
    assert len(got) == len(documents(spark, folder))
    text = {r[0]: r[1] for r in documents(spark, folder)}
    for r in got:
        held = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0
        assert r["held_out"] == held and 0 <= r["score"] <= 1 and r["lang_pred"] in ("en", "fr", "und")
        if r["doc_id"] is not None and not any(c.isalpha() for c in text[r["doc_id"]] or ""):
            assert r["lang_pred"] == "und" and not r["accepted"]
        if r["doc_id"] is not None and 5 <= r["doc_id"] < 65:
            assert r["lang_pred"] == ("fr" if r["doc_id"] % 2 else "en") and r["accepted"]


def plain_fingerprint(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\x0b", " ").replace("\x0c", " ").replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(spark, folder):
    docs = documents(spark, folder)
    prints = [plain_fingerprint(t) for _, t in docs]
    part = list(range(len(docs)))
    while (new := [min(part[j] for j in range(len(docs)) if (prints[i] ^ prints[j]).bit_count() <= 4) for i in range(len(docs))]) != part:
        part = new
    least = {p: min((d for (d, _), q in zip(docs, part, strict=True) if q == p and d is not None), default=None) for p in part}
    got = registry.queries()["op5_pivot_simhash"](spark, folder).collect()
    assert multiset((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got) == multiset((d, f"{x:016x}", least[p]) for (d, _), x, p in zip(docs, prints, part, strict=True))


def test_embeddings(spark, folder):
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding", "label").collect()
    ok = [r for r in rows if r["vec_id"] is not None and r["label"] is not None and r["embedding"] and None not in r["embedding"] and np.isfinite(r["embedding"]).all() and any(r["embedding"])]
    x = np.array([r["embedding"] for r in ok])
    x = x / np.abs(x).max(axis=1, keepdims=True)
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([r["label"] for r in ok])
    near = (x @ x.T >= 0.93) & (label[:, None] == label[None, :])
    part = list(range(len(ok)))
    while (new := [min(part[j] for j in np.flatnonzero(near[i])) for i in range(len(ok))]) != part:
        part = new
    least = {p: min(r["vec_id"] for r, q in zip(ok, part, strict=True) if q == p) for p in part}
    want = [(r["vec_id"], int(near[i].sum()) - 1, least[part[i]], r["vec_id"] == least[part[i]]) for i, r in enumerate(ok)]
    want += [(r["vec_id"], 0, r["vec_id"], r["vec_id"] is not None) for r in rows if r not in ok]
    got = registry.queries()["op6_collision_embeddings"](spark, folder).collect()
    assert multiset((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in got) == multiset(want) and sum(w[1] for w in want) > 200


def test_tokens(spark, folder):
    import sentencepiece
    from tokenizers import Tokenizer

    lib, other = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    sha = lambda b: hashlib.sha256(b).hexdigest()
    words, counts = [], []
    for d, t in documents(spark, folder):
        ids, n = lib.encode(t or "", add_special_tokens=False).ids, len(other.encode(t or ""))
        words.append((d, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(lib.decode(ids, skip_special_tokens=False).encode())))
        counts.append((d, len((t or "").encode()), n, n > 4096))
    assert multiset(tuple(r[c] for c in ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")) for r in registry.queries()["op7_word_table_bpe"](spark, folder).collect()) == multiset(words)
    assert multiset(tuple(r[c] for c in ("doc_id", "n_bytes", "n_tokens", "over_limit")) for r in registry.queries()["op10_token_counts"](spark, folder).collect()) == multiset(counts)
    assert any(c[3] for c in counts) and not spark.catalog.listTables()


def test_toxicity(spark, folder):
    got = registry.queries()["op8_pu_toxicity"](spark, folder).collect()
    assert len(got) == len(documents(spark, folder))
    for r in got:
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)


def test_media(spark, folder):
    got = registry.queries()["op9_gif_columns"](spark, folder).collect()
    want, seen = [], {}
    for d, t in documents(spark, folder):
        raw = (t or "").encode()
        payload = raw + b" " * ((-len(raw)) % 192 or (0 if raw else 192))
        want.append((d, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:])))
    assert multiset(tuple(r[c] for c in ("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32")) for r in got) == multiset(want)
    for r in got:  # equal texts, equal values
        assert seen.setdefault(r["payload_sha256"], (r["media_sha256"], r["media_bytes"], r["feature"])) == (r["media_sha256"], r["media_bytes"], r["feature"])


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    y = spark.read.parquet(f"{sf}/labels.parquet").where("toxic is not null")
    got = registry.queries()["op8_pu_toxicity"](spark, sf).where("held_out").join(y, "doc_id").collect()
    caught, flagged, toxic = (sum(f(r) for r in got) for f in (lambda r: r["predicted"] * r["toxic"], lambda r: r["predicted"], lambda r: r["toxic"]))
    assert caught >= 0.9 * toxic and caught >= 0.9 * flagged


def test_best_fit_packing(spark, folder):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = registry.queries()["op11_linear_grouping"](spark, folder).collect()
    want, total = [], 0
    for d, t in documents(spark, folder):
        ids = np.array([*lib.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        head, total = len(ids) % 2048 or min(len(ids), 2048), total + len(ids)
        at = [0, *range(head, len(ids) + 1, 2048)]
        want += [(d, i, a, z - a, zlib.crc32(ids[a:z].tobytes())) for i, (a, z) in enumerate(zip(at, at[1:], strict=False))]
    assert multiset((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == multiset(want)
    room = {}
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == room.get(r["sequence_id"], 0)
        room[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(room.values()) <= 2048 and len(room) <= -(-total // 2048) + 1


def test_fill_in_middle(spark, folder):
    from test_packing_fim_phrases import plain_fim

    got = registry.queries()["op12_fim_automaton"](spark, folder).collect()
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = [(d, *(x := plain_fim(d, t))[:4], sha(x[4]), sha(t or "")) for d, t in documents(spark, folder)]
    assert multiset(tuple(r[c] for c in ("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")) for r in got) == multiset(want)


def test_collocations(spark, folder):
    from test_packing_fim_phrases import plain_collocations

    rows = [(r["lang"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").select("lang", "text").collect()]
    got = registry.queries()["op13_phrase_automata"](spark, folder).collect()
    assert multiset(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in got) == multiset(plain_collocations(rows, 100, 2000)) and got
