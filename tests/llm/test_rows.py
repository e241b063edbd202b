"""Operators that treat each row by itself: against brute force, with awkward rows."""

import collections
import hashlib
import os
import random
import re

import numpy as np
import pytest

from quarry.llm import bpe, chat, decontaminate, pii, quality
from quarry.llm.words import fingerprint, set_bits, shingle_hashes, word_blocks

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TRICKY = "doc_id bigint, text string, hits string, score string, spans string, n_lines string, node string, words string"


def tricky(spark, texts):
    rows = [(i, t, "h", "s", "x", "l", "n", "w") for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[0], rows[0], (None, "no id", None, None, None, None, None, None), (7, None, None, None, None, None, None, None)], TRICKY)


def empty(spark):
    return spark.createDataFrame([], TRICKY)


# personal data
def luhn(d):
    return sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 if int(c) > 4 else 2 * int(c)) for i, c in enumerate(reversed(d))) % 10 == 0


def base_spans(t):
    t, out = t or "", []
    out += [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m.group())
        if 16 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return out


def test_base_spans_match_brute_force(spark):
    rng = random.Random(3)
    parts = ["a@b.c", "_d@e.f", ".", "@", "1.2.3.4", "256.1.1.1", "0001.2.3.04", "4111 1111 1111 1111", "4111-1111-1111-1112", " ", "+1 (202) 555-0101", "+", "é😀", "12345678901234567890", "5", "-", "\n"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(400)] + ["", "1" * 20000, "1 " * 9000, "a@b.cc " * 2000, "a" * 50000]
    got = pii.personal_data(tricky(spark, texts)).collect()
    assert len(got) == len(texts) + 4
    wanted = dict(enumerate(texts)) | {None: "no id"}
    for r in got:
        own = [(pii.KINDS[x["kind"]], x["start"], x["end"]) for x in r["base"]]
        assert own in (base_spans(wanted[r["doc_id"]]), []) if r["doc_id"] == 7 else own == base_spans(wanted[r["doc_id"]])
        assert set(map(tuple, r["base"])) <= set(map(tuple, r["spans"]))


def test_addresses_with_zero_parts_are_base_spans(spark):
    parts = ["0", "00", "000", "00000", "1", "01", "10", "100", "007", "255", "0255", "256", "0256", "300", "99", "0100", "1000"]
    rng = random.Random(4)
    texts = ["10.0.0.1", "127.0.0.1", "192.168.0.1", "8.8.8.0", "00.1.2.3", "0.0.0.0", "1.2.3", "1.0..2.3", "0" * 4000 + ".0.0.256", "0." * 9000]
    texts += [" ".join(".".join(rng.choice(parts) for _ in range(rng.randint(3, 9))) for _ in range(5)) for _ in range(300)]
    got = {r["doc_id"]: r["base"] for r in pii.personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    for i, t in enumerate(texts):
        assert [(pii.KINDS[x["kind"]], x["start"], x["end"]) for x in got[i]] == base_spans(t), t


def planted(rng, n=1500):
    """Texts in four languages with personal data that the base patterns miss, and look-alikes: (text, spans, decoys)."""
    d = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    name = lambda: "".join(rng.choice("abcdeinorst") for _ in range(6))

    def card():
        body = "4" + d(14)
        return next(body + c for c in "0123456789" if luhn(body + c))

    dots = lambda c: ".".join(c[i : i + 4] for i in range(0, 16, 4))
    tails = ["com", "de", "fr", "es", "org", "net"]
    real = {
        "email": lambda: rng.choice(["write to ", "E-Mail: ", "courriel : ", "correo ", "kontakt "]) + f"<{name()}{rng.choice([' (at) ', '[at]', ' [at] '])}{name()}{rng.choice(['.', ' (dot) ', '[dot]'])}{rng.choice(tails)}>",
        "ip": lambda: rng.choice(["the server ", "Rechner IP ", "adresse ip ", "host "]) + rng.choice([f"<2001:db8:{d(4)}:{d(4)}:1:2:3:{d(3)}>", f"<fe80::{d(4)}:{d(3)}>", f"<{rng.randint(11, 99)}[.]{rng.randint(1, 255)}[.]{rng.randint(1, 255)}[.]{rng.randint(1, 255)}>"]),
        "card": lambda: rng.choice(["card ", "Kreditkarte ", "carte bancaire ", "tarjeta "]) + f"<{dots(card())}>",
        "phone": lambda: rng.choice(["phone ", "Telefon ", "téléphone ", "tel. ", "móvil ", "call "]) + rng.choice([f"<(212) 555-0{d(3)}>", f"<0{rng.randint(30, 89)}/{d(7)}>", f"<01 {d(2)} {d(2)} {d(2)} {d(2)}>", f"<0049 30 {d(7)}>"]),
        "secret": lambda: rng.choice(['token = "', "api_key: ", "Passwort: ", "clave: ", "mot de passe : "]) + f"<{rng.choice(['', 'ghp_', 'AKIA'])}" + "".join(rng.choice("abcdefXYZQRS0123456789") for _ in range(30)) + "7b>",
    }
    fake = [
        lambda: f"version {rng.randint(300, 999)}.{rng.randint(300, 999)}.1.2", lambda: f"at {rng.randint(0, 23)}:{rng.randint(10, 59)}:{rng.randint(10, 59)} o'clock", lambda: f"order {dots('9' + d(15))}" if not luhn("9" + d(15)) else "",
        lambda: f"commit {'%040x' % rng.getrandbits(160)} merged", lambda: f"ISBN 978-{d(1)}-{d(4)}-{d(4)}-{d(1)}", lambda: f"in the year {rng.randint(1000, 2030)} about 12.5 percent", lambda: f"see {name()}-{name()}-{name()}-{name()} for more",
        lambda: f"invoice {rng.randint(100, 199)}-{d(3)}",
    ]
    out = []
    for _ in range(n):
        kinds, text, spans, decoys = [], "", [], []
        for _ in range(rng.randint(1, 4)):
            text += " ".join(name() for _ in range(rng.randint(1, 9))) + " "
            if rng.random() < 0.5:
                kind = rng.choice(list(real))
                piece = real[kind]()
                before, value, after = re.match("(?s)(.*)<(.*)>(.*)", piece).groups()
                start = len(text) + len(before)
                spans.append((kind, start, start + len(value)))
                text += before + value + after
                kinds.append(kind)
            else:
                piece = rng.choice(fake)()
                decoys.append((len(text), len(text) + len(piece)))
                text += piece
            text += rng.choice([". ", "\n", ", "])
        out.append((text, spans, decoys))
    return out


def test_added_spans_on_planted_data(spark):
    """The method finds what no base pattern finds, of each kind, and leaves look-alikes."""
    texts = planted(random.Random(10))
    got = {r["doc_id"]: [(pii.KINDS[x["kind"]], x["start"], x["end"]) for x in r["spans"]] for r in pii.personal_data(spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(texts)], "doc_id bigint, text string")).collect()}
    want, found, wrong = collections.Counter(), collections.Counter(), collections.Counter()
    for i, (_, spans, decoys) in enumerate(texts):
        assert not any(base in spans for base in base_spans(texts[i][0]))
        for kind, s, e in spans:
            want[kind] += 1
            found[kind] += any(k == kind and a < e and s < b and abs(a - s) <= 2 and abs(b - e) <= 2 for k, a, b in got[i])
        for k, a, b in got[i]:
            wrong[k] += (k, a, b) not in base_spans(texts[i][0]) and not any(a < e and s < b for _, s, e in spans)
    print("planted", dict(want), "found", dict(found), "wrong", dict(wrong))
    assert all(found[k] >= 0.9 * want[k] and want[k] > 100 for k in pii.KINDS)
    assert sum(wrong.values()) <= 0.05 * sum(found.values())


def test_clean_text_is_left(spark):
    texts = ["chapter 3.2 of part 17 on page 12345"] * 20 + ["10:45:30 and 2024-05-06, 3 + 4 = 7; a@b"] * 20 + [None, ""]
    got = pii.personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()
    assert len(got) == 42 and not any(r["spans"] for r in got)
    assert pii.personal_data(empty(spark)).count() == 0


# decontamination
def brute_hits(text, bench):
    words = WORD.findall((text or "").translate(LOWER))
    hit, items = set(), set()
    for item, b in bench:
        own = WORD.findall((b or "").translate(LOWER))
        m = min(10, len(own))
        for i in range(len(own) - m + 1 if m else 0):
            for j in range(len(words) - m + 1):
                if words[j : j + m] == own[i : i + m]:
                    hit |= set(range(j, j + m))
                    items.add(item)
    return len(words), len(hit), sorted(items)


@pytest.mark.parametrize("part_bytes", [decontaminate.PART_BYTES, 60])
def test_hits_match_brute_force(spark, part_bytes):
    rng = random.Random(1)
    vocabulary = ["a", "b", "É", "the", "x1", "Cat"]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    bench = [(i, say(n)) for i, n in enumerate([12, 25, 10, 3, 1, 30])] + [(6, None), (7, ""), (8, "?!")]
    bench += [bench[0]]
    texts = [say(rng.randint(0, 60)) + rng.choice(["", " " + bench[1][1].upper() + "! ", " " + bench[5][1]]) + say(20) for _ in range(40)] + ["", "ab" * 100000, say(30000)]
    b = spark.createDataFrame([*bench, (None, "the cat")], "item_id bigint, text string")
    got = decontaminate.contamination(tricky(spark, texts), b, part_bytes=part_bytes).select("doc_id", "text", "score", "hits").collect()
    assert len(got) == len(texts) + 4
    for r in got:
        if len(r["text"] or "") < 20000:
            assert (r["hits"]["n_words"], r["hits"]["n_hit"], r["hits"]["items"]) == brute_hits(r["text"], bench)
    assert decontaminate.contamination(empty(spark), b).count() == 0
    none = decontaminate.contamination(tricky(spark, ["a b"]), b.limit(0)).collect()
    assert all(r["hits"]["n_hit"] == 0 for r in none)


def test_words_across_blocks():
    text = b" ".join(b"w%d" % i for i in range(5000))
    assert [w for b in word_blocks(text, 100) for w in b] == text.split()
    found = decontaminate.matchers([(1, " ".join(f"w{i}" for i in range(100, 130)))])
    assert decontaminate.search(text, found) == (5000, [[100, 130]], {1})


def test_search_over_small_blocks_equals_brute_force(monkeypatch):
    rng, blocks = random.Random(9), decontaminate.word_blocks
    say = lambda n: " ".join(rng.choice(["a", "b", "c", "é", "--", "x" * 9]) for _ in range(n))
    for k in range(200):
        monkeypatch.setattr(decontaminate, "word_blocks", lambda t, k=k: blocks(t, 1 + k % 40))
        bench = [(i, say(rng.choice([1, 2, 3, 4, 9, 10, 11, 14]))) for i in range(4)]
        text = say(40) + " " + bench[0][1] + " ? " + bench[3][1] + " " + say(rng.randint(0, 9))
        n, spans, items = decontaminate.search(text.encode(), decontaminate.matchers(bench))
        assert (n, sum(e - s for s, e in spans), sorted(items)) == brute_hits(text, bench)


def test_memory_of_a_part_is_bounded():
    import tracemalloc

    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(20_000)]
    items = [(i, " ".join(rng.choice(words) for _ in range(200))) for i in range(500)]
    size = sum(len(t) for _, t in items)
    tracemalloc.start()
    found = decontaminate.matchers(items)
    peak, held = tracemalloc.get_traced_memory()[1], tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert found and peak < 60 * size and held < 40 * size  # 240 MB and 160 MB for a whole part


def test_few_words_of_a_block_are_carried_over():
    words = [f"w{i}" for i in range(30)]
    found = decontaminate.matchers([(1, " ".join(words[:12])), (2, " ".join(words[3:6]))])
    for few in range(1, 13):
        text = " ".join(words[:few]) + " " + "-" * (1 << 20) + " " + " ".join(words[few:])
        assert decontaminate.search(text.encode(), found) == (30, [[0, 12]], {1, 2})


# quality
def test_quality_separates_junk_and_scores_every_row(spark):
    rng = random.Random(2)
    prose = lambda: ". ".join(" ".join("".join(rng.choice("etaoin") for _ in range(rng.randint(2, 7))) for _ in range(12)) for _ in range(6)) + "."
    junk = lambda: " ".join("".join(rng.choice("etaoin") for _ in range(5)) + rng.choice(["###", "%%%"]) for _ in range(60))
    texts = [prose() if i % 4 else junk() for i in range(600)]
    docs = tricky(spark, texts)
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(600) if i % 3] + [(None, 1, 0), (3, None, 0), (0, 0, 0)], "doc_id bigint, quality int, toxic int")
    got = quality.score(docs, labels).collect()
    assert len(got) == 604 and all(0 <= r["score"] <= 1 for r in got)
    for r in got:
        if r["doc_id"] is not None and r["text"]:
            assert (r["score"] >= quality.THRESHOLD) == (r["doc_id"] % 4 > 0)
    assert quality.score(empty(spark), labels).count() == 0
    assert all(0 <= r["score"] <= 1 for r in quality.score(docs.limit(5), labels.limit(0)).collect())


def test_fold_and_features():
    assert np.isfinite(quality.features(("é\n" * 50000).encode())).all()
    assert quality.features(None)[-1] == quality.features(b" \n")[-1] == 1 and quality.features(b"a")[-1] == 0


def test_risk_is_never_negative_in_effect():
    rng = np.random.default_rng(0)
    p, n = rng.normal(1, 1, (200, 3)), rng.normal(-1, 1, (200, 3))
    m = quality.fit(p[:20], np.vstack([p, n]), 0.5)
    assert (m(p) > 0.5).mean() > 0.85 and (m(n) < 0.5).mean() > 0.8


@pytest.mark.parametrize("prior", [0.5, 0.9])
def test_weights_minimise_the_risk(prior):
    """Against a plain, independent risk: no small change of the weights lowers it. A prior that is too high
    lets the part of the negatives fall below zero."""
    rng = np.random.default_rng(1)
    one = lambda x: np.hstack([x, np.ones((len(x), 1))])
    p, u = one(rng.normal(1, 1, (300, 2))), one(np.vstack([rng.normal(1, 1, (300, 2)), rng.normal(-1, 1, (300, 2))]))

    def plain(w):
        loss = lambda z: np.mean(np.log1p(np.exp(-z)))
        return prior * loss(p @ w) + max(0.0, loss(-(u @ w)) - prior * loss(-(p @ w)))

    w = quality.minimised(p, u, prior, 1e-5)
    assert abs(plain(w) - quality.risk(w, p, u, prior)[0]) < 1e-9
    if prior == 0.5:
        assert all(plain(w) <= plain(w + d) + 1e-4 for d in rng.normal(0, 0.05, (200, 3)))
    else:
        free = quality.newton(u, prior * p.mean(axis=0), 1e-5)
        assert quality.risk(free, p, u, prior)[1] < -1 and quality.risk(w, p, u, prior)[1] > -0.05 and np.abs(w).max() < 20


def test_prior_is_estimated_from_positives_and_unlabelled_rows():
    rng = np.random.default_rng(2)
    one = lambda x: np.hstack([x, np.ones((len(x), 1))])
    for true in (0.2, 0.5, 0.8):
        draw = lambda n, share: np.where(rng.random((n, 1)) < share, rng.normal(2, 1, (n, 4)), rng.normal(-2, 1, (n, 4)))
        assert abs(quality.class_prior(one(draw(3000, 1)), one(draw(6000, true))) - true) < 0.05


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="needs the test tables")
def test_held_out_accuracy(spark):
    """Of the rows that nothing was learnt from, how many are told as their label says."""
    d = "/root/testdata/sf0.1"
    rows = quality.op7_pu(spark, d).where("held_out").join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").select("quality", "predicted", "score").collect()
    good, bad = ([r["score"] for r in rows if r["quality"] == k] for k in (1, 0))
    auc = np.mean([np.mean([(g > b) + 0.5 * (g == b) for b in bad]) for g in good])
    print("held out", len(good), len(bad), "kept", np.mean([s >= quality.THRESHOLD for s in good]), "rejected", np.mean([s < quality.THRESHOLD for s in bad]), "auc", auc)
    assert len(good) > 50 and len(bad) > 20
    assert np.mean([s >= quality.THRESHOLD for s in good]) > 0.98 and np.mean([s < quality.THRESHOLD for s in bad]) > 0.95 and auc > 0.98


def test_hot_ids_and_texts_do_not_flood_the_sample(spark):
    rows = [(None, "a hot text that is repeated")] * 3000 + [(i, f"own text number {i}") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(150)], "doc_id bigint, quality int, toxic int")
    model = quality.train(docs, labels, sample=1000)
    assert 0 < model.prior < 1 and quality.score(docs, labels, 1000).count() == 3200


# tokens
@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_path())


def test_tree_equals_the_library(tokenizer):
    rng, own = random.Random(1), bpe.ByteBpe(bpe.default_path(), leaf=16)
    alphabets = ["abcdefghij", "thequickbrown", "aaaa", "éüß漢字😀", "01", "!?-#", "x"]
    for k in range(800):
        a = rng.choice(alphabets) + rng.choice(alphabets)
        s = "".join(rng.choice(a) for _ in range(rng.randint(0, 200)))
        if k % 5 == 0:
            s += " " * rng.randint(0, 60) + "b<|endoftext|>c  \n\n\t " + s
        want = tokenizer.encode(s, add_special_tokens=False).ids
        assert own.encode(s).tolist() == want
        assert own.decode(own.encode(s)).decode() == tokenizer.decode(want, skip_special_tokens=False)


def test_megabytes_that_nothing_splits(tokenizer):
    rng, own = random.Random(4), bpe.codec(bpe.default_path())
    texts = ["a" * 2_000_000, "".join(rng.choice("etaoinshrdlu") for _ in range(1_500_000)), "漢字かな交じり" * 60_000, " " * 300_000 + "x" + "\t" * 300_000, "ab" * 400_000 + " " + "=-" * 300_000]
    for text in texts:
        want = tokenizer.encode(text, add_special_tokens=False).ids
        ids = own.encode(text)
        assert ids.tolist() == want and own.decode(ids) == text.encode()


def test_bytes_that_are_no_text():
    own = bpe.codec(bpe.default_path())
    assert own.decode(np.array([own.ranks[b"\xff"], own.ranks[b"a"]])) == "�a".encode()
    assert own.decode(np.empty(0, np.uint32)) == b""


def test_encode_rows(spark, tokenizer):
    texts = ["Hello world", "", "a" * 5000, "l'été <|endoftext|> x", "\n\n  \t", "q" * 3000 + " and 漢字" * 500]
    got = bpe.encode(tricky(spark, texts)).collect()
    assert len(got) == len(texts) + 4 and all(r["exact"] for r in got)
    for r in got:
        if r["doc_id"] is not None and r["doc_id"] < len(texts):
            ids = np.frombuffer(r["ids"], "<u4").tolist()
            assert ids == tokenizer.encode(texts[r["doc_id"]], add_special_tokens=False).ids and r["n_tokens"] == len(ids)
    digests = bpe.encode(tricky(spark, texts), digests=True).where("doc_id = 0").first()
    data = np.array(tokenizer.encode(texts[0], add_special_tokens=False).ids, "<u4").tobytes()
    assert digests["ids_sha256"] == hashlib.sha256(data).hexdigest() and digests["decoded_sha256"] == hashlib.sha256(texts[0].encode()).hexdigest()
    assert bpe.encode(empty(spark)).count() == 0


# dialogues
def render(turns, who):
    """The dialogue as ``who`` sees it, and the mask, in plain Python."""
    out, mask = "", []
    plain = lambda t: (t or "").replace("<|", "< |")
    for _, role, text in sorted(turns, key=lambda t: [(x is not None, x if x is not None else 0) for x in t]):
        out += "<|assistant|>\n" if role == who else "<|system|>\n" if role == "system" else f"<|user name={plain(role if role is not None else 'unknown')}|>\n"
        body = plain(text) + "<|end|>"
        if role == who:
            mask.append((len(out), len(out) + len(body)))
        out += body + "\n"
    return out, mask


@pytest.mark.parametrize("part_chars", [chat.PART_CHARS, 300])
def test_every_perspective(spark, part_chars):
    rng = random.Random(8)
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi <|end|>"), (1, 2, "bob", "yo 漢😀"), (1, 3000, "ann", None), (1, None, None, "?"), (2, 0, "system", "x"), (None, 0, "ann", "a"), (None, 0, "ann", "a"), (5, 1, "<|x", "")]
    rows += [(c, rng.choice([None, rng.randrange(40)]), rng.choice(["ann", "bob", "cy", "system", None]), rng.choice([None, "", "word " * rng.randint(0, 30)])) for c in (7, 8) for _ in range(120)]
    rows += [(9, 4, "ann", "same")] * 60 + [(10, 1, "ann", "long " * 20_000), (10, 2, "bob", "ok")]
    got = chat.rotate(spark.createDataFrame([(*r, "x", "y") for r in rows], "conv_id bigint, turn bigint, role string, text string, part string, participant string"), part_chars).collect()
    convs = collections.defaultdict(list)
    for c, *t in rows:
        convs[c].append(tuple(t))
    want = {(c, who): render(t, who) for c, t in convs.items() for who in {r for _, r, _ in t} - {"system", None}}
    parts = collections.defaultdict(list)
    for r in got:
        parts[r["conv_id"], r["participant"]].append(r)
    assert set(parts) == set(want)
    for key, own in parts.items():
        own.sort(key=lambda r: r["part"])
        whole, mask, n = "", [], 0
        for r in own:
            mask += [(m["start"] + len(whole), m["end"] + len(whole)) for m in r["mask"]]
            whole, n = whole + r["rendered"], n + r["n_own"]
            assert len(r["mask"]) == r["n_own"]
        assert (whole, mask) == want[key] and n == len(mask)
        assert sum(r["n_turns"] for r in own) == len(convs[key[0]])
        assert part_chars == 300 or len(own) == 1
    assert part_chars != 300 or len(parts[9, "ann"]) > 3 and max(r["n_turns"] for r in parts[9, "ann"]) <= 300 // 16
    assert chat.rotate(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")).count() == 0


# fingerprints
def test_bit_counts_and_fingerprints():
    import xxhash

    h = np.random.default_rng(0).integers(0, 2**63, 1000).astype(np.uint64)
    assert (set_bits(h) == [int(((h >> np.uint64(b)) & np.uint64(1)).sum()) for b in range(64)]).all()
    assert fingerprint(None)[0] == fingerprint(b" \n\t")[0] == 0 and fingerprint(b"One", 3)[0] == xxhash.xxh64_intdigest(b"one", 42)
    assert fingerprint(b"A b\xc2\xa0c", 3)[0] == xxhash.xxh64_intdigest("a b c".encode(), 42)
    words = [b"w%d" % (i % 37) for i in range(200_000)]
    whole = np.concatenate(list(shingle_hashes(b"\n".join(words), 3, 42)))
    assert len(whole) == len(words) - 2
