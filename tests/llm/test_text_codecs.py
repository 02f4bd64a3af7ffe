"""Packing, chat formatting, SentencePiece, URL filter and language-model scores against brute force or round trips."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

import brute
from dendra.llm import byte_bpe, chat, lm_scoring, packing, queries, sentencepiece_codec, url_filter
from dendra.llm.common import table

random.seed(11)
ODD = [None, "", " ", "a", "  two  spaces ", "<|endoftext|> a <|endoftext|>", "é😀 ﬁ \u2028 x", "a\x00b", "word " * 9000, "x" * 20000, "don't I'll we've", "</s>[INST] ok [/INST]", "ⅷ½ 12,3"]


def docs(spark, texts):
    return spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, ids long")


# packing


def expected_ids(texts):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return {i: [*t.encode(x or "", add_special_tokens=False).ids, 0] for i, x in texts.items()}


def check_pieces(rows, want, length=1024):
    per_doc, per_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        per_doc[r["doc_id"]].append(r)
        per_seq[r["sequence_id"]].append(r)
    assert set(per_doc) == set(want)
    for i, own in per_doc.items():
        own.sort(key=lambda r: r["start"])
        at = 0
        for r in own:
            ids = np.array(want[i][at : at + r["length"]], "<u4").tobytes()
            assert r["start"] == at and r["length"] > 0 and r["doc_tokens"] == len(want[i])
            assert (r["ids_crc32"] if "ids_crc32" in r else zlib.crc32(r["ids"])) == zlib.crc32(ids)
            at += r["length"]
        assert at == len(want[i])
    total = padded = 0
    for own in per_seq.values():
        own.sort(key=lambda r: r["offset"])
        at = 0
        for r in own:
            assert r["offset"] == at
            at += r["length"]
        assert at <= length and {r["sequence_tokens"] for r in own} == {at}
        total += at
        padded += at if at & (at - 1) == 0 else length
    assert padded == total  # full, or a power of two


def test_packing_query(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in table(spark, sf_dir, "documents").collect()}
    check_pieces([r.asDict() for r in queries.packed(spark, sf_dir).collect()], expected_ids(texts))


def test_encoder_equals_the_tokenizer():
    t, e = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), byte_bpe.load()
    assert e.fast is not None
    bits = ["a", "the", "Thing", "'s", "don't", "12", "!", "...", "é", "日本", "\U0001f600", "x-y", "<|endoftext|>", "\u0120", "\u010a"]
    spaces = [" ", " ", " ", "\n", "\n", "  ", "\n\n", " \n", "\n ", "\t", "\r\n", "\xa0", "\u2028", "\x1c", "\x0b", "   "]
    texts = ["", " ", "\n", " a", "a ", "a\n", "\na", "a b\nc"]
    for p in (0.9, 0.5):
        texts += ["".join(random.choice(bits) + (random.choice(spaces[:5]) if random.random() < p else random.choice(spaces)) for _ in range(random.randint(1, 9))) + random.choice(bits) for _ in range(2000)]
    for x in texts:
        assert e.ids(x).tolist() == t.encode(x, add_special_tokens=False).ids, x


def test_encoder_over_all_code_points():
    t, e = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), byte_bpe.load()
    points = [chr(c) for c in [*range(0xD800), *range(0xE000, 0x20000)]]
    for between in ("", "a", "1 "):
        for i in range(0, len(points), 4096):
            x = between.join(points[i : i + 4096])
            assert e.ids(x).tolist() == t.encode(x, add_special_tokens=False).ids, (between, i)


def test_encoder_offsets_and_long_runs():
    t, controls = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), tuple(chat.CONTROLS)
    e = byte_bpe.load(None, controls)
    texts = [x for x in ODD if x] + ["<s>[INST] é日本 \n\n x[/INST] ok</s>", " " * 300_000 + "a", "a" * 300_000, "\n" * 300_000]
    for x in texts:
        ids, starts, ends = e.spans(x)
        code = e.tokenizer.encode(x, add_special_tokens=False)
        assert ids.tolist() == code.ids and list(zip(starts.tolist(), ends.tolist())) == code.offsets, x[:50]
        assert byte_bpe.load().ids(x).tolist() == t.encode(x, add_special_tokens=False).ids


def test_encoder_of_another_kind_of_tokenizer(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    t, e = Tokenizer.from_file(path), byte_bpe.load(path)
    texts = ["cafe\u0301 ole", "can'T stop 'S", "A  b", "", None, "日本"]
    assert e.fast is None and e.ids("can'T stop 'S").tolist() == t.encode("can'T stop 'S", add_special_tokens=False).ids
    rows = packing.pack(docs(spark, texts), tokenizer_path=path).collect()
    check_pieces([r.asDict() for r in rows], {i: [*t.encode(x or "", add_special_tokens=False).ids, 0] for i, x in enumerate(texts)})


def test_ids_that_are_no_numbers_are_refused(spark):
    df = spark.createDataFrame([("x1", "a", 0, "user")], "doc_id string, text string, turn int, role string")
    with pytest.raises(ValueError, match="doc_id"):
        packing.pack(df)
    with pytest.raises(ValueError, match="doc_id"):
        lm_scoring.score(df)
    with pytest.raises(ValueError, match="conv_id"):
        chat.format_chats(df.withColumnRenamed("doc_id", "conv_id"))


def test_ranges_follow_the_tokens():
    for cells, ranges in (([(3, 10), (7, 1000), (8, 5)], 10), ([(0, 1)], 4), ([(i, i % 7) for i in range(500)], 16), ([(0, 0), (1, 8)], 3)):
        load = defaultdict(float)
        for (cell, n), (same, first, span) in zip(cells, packing.ranges_of(cells, ranges)):
            assert cell == same and 0 <= first and first + span <= ranges and span > 0
            for r in range(first, first + span):
                load[r] += n / span
        assert max(load.values()) <= 2 * sum(n for _, n in cells) / ranges + max(1, *(n for _, n in cells if n * ranges < sum(n for _, n in cells)), 0)


@pytest.mark.parametrize("length", [1024, 16, 1])
def test_packing_cases(spark, length):
    texts = dict(enumerate([*ODD[:8], *ODD[10:]] + ["copy of one text"] * 30))
    rows = packing.pack(docs(spark, texts.values()), length=length, range_bytes=200).collect()
    check_pieces([r.asDict() for r in rows], expected_ids(texts), length)


def test_packing_long_and_empty(spark):
    texts = dict(enumerate(ODD))
    check_pieces([r.asDict() for r in packing.pack(docs(spark, ODD)).collect()], expected_ids(texts))
    assert packing.pack(docs(spark, ["a"]).limit(0)).count() == 0
    with pytest.raises(ValueError):
        packing.pack(docs(spark, ["a"]), length=1000)


def test_hilbert_curve_visits_neighbours():
    bits = 3
    cells = np.array([[x, y, z] for x in range(8) for y in range(8) for z in range(8)])
    keys = packing.hilbert_key(cells, bits)
    assert sorted(keys) == list(range(512))
    walk = cells[np.argsort(keys)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_neighbours_on_the_curve_are_alike(spark):
    """Documents of one language share sequences more often than a shuffle would have it."""
    words = {k: [f"{k}{i}" for i in range(60)] for k in ("ab", "xy")}
    texts = [" ".join(random.choices(words[k], k=150)) for k in ("ab", "xy") for _ in range(40)]
    random.shuffle(texts)
    kind = {i: t[:2] for i, t in enumerate(texts)}
    per = defaultdict(set)
    for r in packing.pack(docs(spark, texts)).collect():
        per[r["sequence_id"]].add(kind[r["doc_id"]])
    assert sum(len(s) == 1 for s in per.values()) > 0.6 * len(per)


# chat


def test_escape_is_reversible():
    bits = ["<", ">", "/", "s", "\\", "[", "INST", "]", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "a", "\n"]
    for _ in range(5000):
        t = "".join(random.choices(bits, k=random.randint(0, 12)))
        e = chat.escape(t)
        assert chat.unescape(e) == t and not any(c in e for c in chat.CONTROLS), t


def test_render_and_parse():
    for _ in range(500):
        turns = [(random.choice(["user", "assistant", "system", "tool", "", "[ROLE]x"]), random.choice(["", " ", "</s>[INST] ok [/INST]", "<", "[", "\\", "text\n", "é😀"])) for _ in range(random.randint(0, 6))]
        assert chat.parse(chat.render(turns).text) == turns
    for bad in ("", "x", "<s>open[/INST]", "<s>[INST]a</s>", "<s>tail"):
        with pytest.raises((ValueError, IndexError)):
            chat.parse(bad)


def test_loss_tokens_by_binary_search():
    for _ in range(300):
        cuts = sorted(random.sample(range(60), 20))
        offsets = list(zip(cuts, cuts[1:]))
        ends = sorted(random.sample(range(60), 6))
        spans = [(a, b, random.choice(["assistant", "user"])) for a, b in zip(ends[::2], ends[1::2])]
        mask, covered = chat.loss_tokens(spans, np.array(cuts[:-1]), np.array(cuts[1:]))
        own = [(a, b) for a, b, r in spans if r == "assistant"]
        assert mask.tolist() == [any(s < b and e > a for a, b in own) for s, e in offsets]
        want = {c for a, b in own for c in range(a, b) if cuts[0] <= c < cuts[-1]}
        assert sorted(c for a, b in covered for c in range(a, b)) == sorted(want)


def check_chats(rows, turns_of):
    assert len(rows) == len(turns_of)
    for r in rows:
        turns = turns_of[r["conv_id"]]
        loss = "".join(t or "" for role, t in turns if role == "assistant")
        assert r["n_turns"] == len(turns) and r["turns_sha256"] == brute.turns_digest(turns)
        assert r["loss_chars"] == len(loss) and r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()


def test_chat_query(spark, sf_dir):
    turns = defaultdict(list)
    for r in sorted(table(spark, sf_dir, "conversations").collect(), key=lambda r: (r["conv_id"], r["turn"])):
        turns[r["conv_id"]].append((r["role"], r["text"]))
    turns[-1] = [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]
    check_chats(queries.chats(spark, sf_dir).collect(), turns)


def test_chat_cases(spark):
    rows = [(1, 0, "assistant", t) for t in ODD if t] + [(2, 1, "b", "x"), (2, 0, "assistant", " lead"), (2, 2, "assistant", "\n \ntrail \n"), (2, None, "user", None), (None, 0, None, "x"), (3, 0, "user", ""), (3, 0, "user", ""), (4, 0, "assistant", "日本語é" * 50)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn int, role string, text string, formatted string")
    turns = defaultdict(list)
    key = lambda r: tuple((x is not None, x if isinstance(x, int) else (x or "").encode()) if x is not None else (False,) for x in r[1:])
    for r in sorted(rows, key=key):
        turns[r[0]].append((r[2], r[3]))
    out = chat.format_chats(df)
    check_chats(chat.read_back(out).collect(), turns)
    for r in out.collect():
        assert len(r["token_ids"]) == len(r["loss_mask"])
    assert chat.format_chats(df.limit(0)).count() == 0


def test_rows_without_a_conversation_stand_alone(spark):
    df = spark.range(3000).selectExpr("cast(null AS long) AS conv_id", "1 AS turn", "'user' AS role", "'x' AS text")
    out = chat.read_back(chat.format_chats(df))
    assert out.count() == 3000 and out.where("conv_id IS NULL AND n_turns = 1").count() == 3000


# SentencePiece


@pytest.fixture(scope="module")
def own():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(sentencepiece_codec.MODEL))


def test_parity_with_the_library(own, spark, sf_dir):
    c = sentencepiece_codec.Codec()
    texts = [r["text"] for r in table(spark, sf_dir, "documents").collect()] + [t for t in ODD if t is not None and "\x00" not in t]
    bits = [" ", " ", " ", "  ", " " * 17, "a", "\n ", " \n", "\n\n", "\u2028", "x<s>", "the", "er", "\n", "é", "日", ".", "1", "T", "ion", "▁", "\t"]
    texts += ["".join(random.choices(bits, k=random.randint(0, 30))) for _ in range(3000)]
    coded = [x.tolist() for x in c.encode(texts)]
    assert c.by_word and coded == own.encode(texts)
    assert c.decode([np.array(x, np.int32) for x in coded]) == [t.replace("▁", " ") for t in texts]


def test_broken_bytes_are_decoded(own):
    c = sentencepiece_codec.Codec()
    for ids in ([3 + 0xE9, 3 + 0x41], [3 + 0xFF] * 3, []):
        assert c.decode([np.array(ids, np.int32)])[0] == c.tokenizer.decode(ids)


def test_codec_over_a_table(spark, own):
    df = docs(spark, ODD).withColumnRenamed("ids", "decoded")
    got = sentencepiece_codec.decode(sentencepiece_codec.encode(df))
    assert got.columns == ["doc_id", "text", "piece_ids", "decoded"]
    for r in got.collect():
        assert r["decoded"] == r["text"] and (r["piece_ids"] is None) == (r["text"] is None)
        assert r["text"] is None or "\x00" in r["text"] or r["piece_ids"] == own.encode(r["text"])
    assert sentencepiece_codec.encode(df.limit(0)).count() == 0


def sentencepiece_rows(own, rows):
    """The query's rows from the library alone."""
    out = []
    for i, t in rows:
        ids = None if t is None else own.encode(t)
        back = None if t is None else own.decode(ids)
        crc = lambda x: None if x is None else zlib.crc32(x.encode())
        out.append((str(i), None if ids is None else len(ids), crc(None if ids is None else ",".join(map(str, ids))), crc(back)))
    return sorted(out, key=str)


def test_sentencepiece_query(spark, sf_dir, own):
    got = queries.sentencepiece_round_trip(spark, sf_dir).collect()
    assert all(r["round_trip"] for r in got)
    want = sentencepiece_rows(own, [tuple(r) for r in table(spark, sf_dir, "documents").select("doc_id", "text").collect()])
    assert sorted([(str(r["doc_id"]), r["n_pieces"], r["ids_crc32"], r["decoded_crc32"]) for r in got], key=str) == want


def test_sentencepiece_null_ids_and_repeated_rows(spark, tmp_path, own):
    odd = [(None, "a b"), (None, "a b"), (3, "x  y\n"), (3, "x  y\n"), (None, None), (4, "")]
    spark.createDataFrame(odd, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.sentencepiece_round_trip(spark, str(tmp_path)).collect()
    assert sorted([(str(r["doc_id"]), r["n_pieces"], r["ids_crc32"], r["decoded_crc32"]) for r in got], key=str) == sentencepiece_rows(own, odd)


def test_unigram_model_is_rebuilt():
    """A hand-made model file: scores, byte fallback and spaces as the library has them."""

    def field(number, data):
        head = bytes([number << 3 | 2])
        return head + bytes([len(data)]) + data

    import struct

    pieces = [("<unk>", 0.0, 2), *[(f"<0x{b:02X}>", 0.0, 6) for b in range(256)], ("▁", -2.0, 1), ("a", -3.0, 1), ("b", -3.0, 1), ("▁a", -1.5, 1), ("ab", -2.5, 1), ("▁ab", -4.5, 1)]
    data = b"".join(field(1, field(1, p.encode()) + b"\x15" + struct.pack("<f", s) + bytes([3 << 3, k])) for p, s, k in pieces)
    data += field(2, bytes([3 << 3, 1, 35 << 3 & 127 | 128, 35 << 3 >> 7, 1])) + field(3, b"\x18\x01\x20\x00\x28\x01")
    m = sentencepiece_codec.parse_model(data)
    assert m.kind == sentencepiece_codec.UNIGRAM and m.byte_fallback and len(m.pieces) == len(pieces)
    t, lib = sentencepiece_codec.build(m), sentencepiece.SentencePieceProcessor(model_proto=data)
    for text in ("ab ab", "a  b", "abba é", "", " ab"):
        assert t.encode(text, add_special_tokens=False).ids == lib.encode(text)


# URL filter


def test_url_parts_and_rules(spark, sf_dir):
    urls = [None, "", "no scheme/x", "http://", "HTTP://Example.ORG/es/1", "http://example.org", "x://a.org/?q", "http://ÄB.com/de/x?y#z", "http://u@h.com:80/fr/", "a://b://c/d", "http://example.org/en/1", "http://notexample.org/es/", "http://com/de/", "http://xcom/de/", "http://m.example.org?x=/es/", "http://a.example.org/en/2#/en/1", "http://h/\n\n/p"]
    urls += [r["url"] for r in table(spark, sf_dir, "pages").collect()]
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, host string")
    for r in url_filter.judge(df).collect():
        u = urls[r["page_id"]] or ""
        host, path = url_filter.split_url(u)
        if "://" not in u:
            assert (host, path) == ("", "")
        assert (r["host"], r["path"]) == (host, path), u
        fit = [x for x in url_filter.RULES if (host == x.host or host.endswith("." + x.host)) and path.startswith(x.path)]
        best = max(fit, key=lambda x: len(x.name), default=None)
        assert r["rule"] == (best and best.name)
        assert r["verdict"] == (best.verdict if best else "block" if r["p_block"] >= 0.5 else "allow")
    assert url_filter.judge(df.limit(0)).count() == 0


def held_out(fold_of, folds=3):
    """(recall, precision, accuracy) on urls of folds that a model was not trained on."""
    rows, got = url_filter.seeds(), []
    for k in range(folds):
        m = url_filter.train([r for i, r in enumerate(rows) if fold_of(i) % folds != k])
        own = [r for i, r in enumerate(rows) if fold_of(i) % folds == k]
        got += zip((y for _, y in own), m.probability(*map(list, zip(*(url_filter.split_url(u) for u, _ in own)))) >= 0.5)
    found, said, unwanted = sum(y and b for y, b in got), sum(b for _, b in got), sum(y for y, _ in got)
    return found / unwanted, found / said, sum(bool(y) == bool(b) for y, b in got) / len(got)


def test_classifier_on_held_out_urls():
    recall, precision, _ = held_out(lambda i: i)  # other hosts, of words seen
    assert recall > 0.9 and precision > 0.9, (recall, precision)
    recall, precision, right = held_out(lambda i: i // url_filter.SEED_ROWS)  # hosts of words never seen: what n-grams carry over
    assert recall > 0.35 and right > 0.8, (recall, precision, right)
    m = url_filter.default_model()
    unwanted = ["www.spam-farm.example.com", "m.casino-win.example.com", "ads-track.example.net", "cheap-pills.example.org", "adult-x.example.com"]
    wanted = ["blog.tionsh.example.com", "www.example.org", "cityhall.net", "m.ththth.example.net", "schoolbus.com"]
    assert not {w for h in unwanted for w in h.split(".")[-3].split("-")} & set(url_filter.WANTED + url_filter.UNWANTED)
    assert (m.probability(unwanted, ["/en/1"] * 5) > 0.5).all() and (m.probability(wanted, ["/en/1"] * 5) < 0.5).all()
    assert m.probability([""], [""])[0] == 0


def test_probability_by_another_way(spark, sf_dir):
    m = url_filter.default_model()
    for r in queries.url_filters(spark, sf_dir).limit(200).collect():
        z = m.bias
        for weights, text, share in ((m.host, "^" + r["host"] + "$", 1), (m.path, ">" + r["path"], url_filter.PATH_SHARE)):
            raw = text.encode()
            pieces = [raw[i : i + n] for n in (3, 4, 5) for i in range(len(raw) - n + 1)]
            z += share * sum(weights[zlib.crc32(p) % (1 << 14)] for p in pieces) / math.sqrt(max(1, len(pieces)))
        want = 1 / (1 + math.exp(-z)) if r["host"] or r["path"] else 0
        assert abs(r["p_block"] - want) < 2e-6


def test_labelled_rows_are_sampled_from_both_classes(spark):
    rows = [(f"http://a{i}.net/", 0) for i in range(500)] + [(f"http://z{i}.net/", 1) for i in range(300)]
    got = url_filter.sampled(spark.createDataFrame(rows, "url string, label int"), 100)
    assert Counter(y for _, y in got) == {0: 50, 1: 50} and len({u[8] for u, _ in got}) > 1
    assert sorted(got) == sorted(url_filter.sampled(spark.createDataFrame(rows[::-1], "url string, label int"), 100))


def test_url_cases(spark):
    rules = (url_filter.Rule("b.net", "/x", "block"), url_filter.Rule("net", "/x/y", "allow"), url_filter.Rule("b.net", "/y", "allow"))
    urls = ["http://a.b.net/x/y", "http://b.net/y", "http://a.net/" + "p" * 100_000, "http://casinos.net/", "http://casinos.net/"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").selectExpr("*", "'old' AS host", "7 AS verdict")
    got = {r["page_id"]: r for r in url_filter.judge(df, rules=rules).collect()}
    assert (got[0]["rule"], got[0]["verdict"]) == ("b.net/x", "block")  # as long as net/x/y, and first by name
    assert got[1]["verdict"] == "allow" and got[2]["path"] == "/" + "p" * 100_000 and got[2]["host"] == "a.net"
    assert got[3][1:] == got[4][1:] and got[3]["verdict"] == "block"


def test_training_table(spark):
    labelled = spark.createDataFrame([(f"http://good{i}.net/a", 0) for i in range(20)] + [(f"http://evil{i}.net/b", 1) for i in range(20)] + [(None, 1), ("x", None)], "url string, label int")
    df = spark.createDataFrame([(1, "http://evil77.net/b"), (2, "http://good77.net/a")], "page_id long, url string")
    assert [r["verdict"] for r in url_filter.judge(df, labelled=labelled).orderBy("page_id").collect()] == ["block", "allow"]
    with pytest.raises(ValueError):
        url_filter.train([("http://a.net/", 1)])


# language-model scores


def grams_of(text):
    w = brute.WORD.findall(text or "")
    return w, Counter(tuple(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1))


def brute_scores(texts, corpus=None, alpha=0.4):
    """corpus None: the texts themselves, each without its own counts."""
    total = Counter()
    for t in texts if corpus is None else corpus:
        total.update(grams_of(t)[1])
    all_words = sum(n for k, n in total.items() if len(k) == 1)
    out = []
    for t in texts:
        w, own = grams_of(t)
        c = (lambda k: total[k] - own[k]) if corpus is None else total.__getitem__
        n = max(1, all_words - (len(w) if corpus is None else 0))
        s = backed = 0
        for i in range(len(w)):
            order, cost = min(i + 1, 3), 0
            while order > 1 and not c(tuple(w[i - order + 1 : i + 1])):
                order, cost = order - 1, cost + math.log(alpha)
            backed += cost < 0
            s += cost + (math.log(c(tuple(w[i - order + 1 : i + 1])) / c(tuple(w[i - order + 1 : i]))) if order > 1 else math.log(max(1, c((w[i],))) / n))
        out.append((len(w), backed, s if w else None))
    return out


def check_scores(df, want):
    got = {r["doc_id"]: r for r in df.collect()}
    assert len(got) == len(want)
    for i, (n, backed, s) in enumerate(want):
        r = got[i]
        assert (r["n_words"], r["n_backed_off"]) == (n, backed)
        assert (r["log_prob"] is None and r["lm_score"] is None) if s is None else math.isclose(r["log_prob"], s, rel_tol=1e-9, abs_tol=1e-6)


@pytest.mark.parametrize("block", [1 << 21, 300])
def test_scores_by_own_corpus(spark, sf_dir, monkeypatch, block):
    monkeypatch.setattr(lm_scoring, "BLOCK_CHARS", block)
    texts = ODD + [r["text"] for r in table(spark, sf_dir, "documents").collect()][:60]
    want = brute_scores(texts)
    assert sum(b for _, b, _ in want) > 100
    check_scores(lm_scoring.score(docs(spark, texts), part_bytes=20_000), want)


def test_scores_by_another_corpus(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(lm_scoring, "BLOCK_CHARS", 20_000)
    all_ = [r["text"] for r in table(spark, sf_dir, "documents").collect()]
    texts, corpus = ODD + all_[:50], all_[40:150] + [None, ""]
    check_scores(lm_scoring.score(docs(spark, texts), docs(spark, corpus)), brute_scores(texts, corpus))
    check_scores(lm_scoring.score(docs(spark, texts), docs(spark, corpus).limit(0)), brute_scores(texts, []))


def test_copies_stand_out(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choices([f"w{i}" for i in range(300)], k=80)) for _ in range(40)]
    score = {r["doc_id"]: r["lm_score"] for r in lm_scoring.score(docs(spark, [*texts, texts[7]])).collect()}
    assert min(score[7], score[40]) > max(v for k, v in score.items() if k not in (7, 40)) + 1


def test_word_hashes_and_packed_rows(monkeypatch):
    texts = [(x or "").encode() for x in ODD] + [b"a b", b"b a", b" a\x0bb\x1cc "]
    words, owner = lm_scoring.words_of(texts)
    plain = [(i, w) for i, t in enumerate(texts) for w in t.split()]
    assert owner.tolist() == [i for i, _ in plain]
    seen = {}
    assert all(seen.setdefault(w, h) == h for (_, w), h in zip(plain, words.tolist())) and len(set(seen.values())) == len(seen)
    monkeypatch.setattr(lm_scoring, "HASH_BYTES", 50)
    assert all((a == b).all() for a, b in zip(lm_scoring.words_of(texts), (words, owner)))
    many = [f"{a}{b}{c}" for a in "abcdefghij" for b in "abcdefghij" for c in "abcdefghij"]
    assert len(set(lm_scoring.words_of([" ".join(many).encode()])[0].tolist())) == 1000
    for n in (0, 1, 5, 3000):
        x = np.sort(np.random.default_rng(n).integers(0, 1 << 48, n, np.uint64))
        assert (lm_scoring.places(*lm_scoring.packed_places(x)) == x).all()
    for most in (1, 300, 70_000):
        assert lm_scoring.numbers(lm_scoring.packed_numbers(np.array([0, most])), 2).tolist() == [0, most]


@pytest.mark.parametrize("parts", [1, 7, 1 << 17])
def test_partitions_have_no_cap_and_keep_the_order(parts):
    h = np.unique(np.random.default_rng(1).integers(0, 1 << 64, 200_000, np.uint64))
    part = np.searchsorted(lm_scoring.part_starts(parts), h, "right") - 1
    assert part.tolist() == [(int(x) * parts) >> 64 for x in h]
    place = lm_scoring.place_in_part(h, parts)
    assert int(place.max()) < 1 << 48 and all(a < b or p != q for a, b, p, q in zip(place.tolist(), place[1:].tolist(), part.tolist(), part[1:].tolist()))


def test_scores_of_empty_and_null_ids(spark):
    assert lm_scoring.score(docs(spark, ["a"]).limit(0)).count() == 0
    df = spark.createDataFrame([(None, "a b"), (None, "a b"), (3, None)], "doc_id long, text string")
    got = lm_scoring.score(df).collect()
    assert Counter((r["doc_id"], r["n_words"]) for r in got) == Counter({(None, 2): 2, (3, 0): 1})


def test_query_over_whole_table(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").collect()
    want = brute_scores([r["text"] for r in rows])
    got = {r["doc_id"]: r for r in queries.lm_scores(spark, sf_dir).collect()}
    assert sum(r["n_backed_off"] for r in got.values()) > 0
    for r, (n, backed, s) in zip(rows, want):
        assert (got[r["doc_id"]]["n_words"], got[r["doc_id"]]["n_backed_off"]) == (n, backed) and abs(got[r["doc_id"]]["log_prob"] - s) < 1e-3


