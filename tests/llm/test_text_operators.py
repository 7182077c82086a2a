"""Operators on documents against brute force, over odd rows and empty tables."""

import hashlib
import random
import zlib
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from docloom.llm import avi, bpe, language, pii, simhash, substrings
from tests.llm import brute

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def same(got, want):
    assert Counter(map(tuple, got)) == Counter(want)


def test_simhash(odd, odd_rows):
    got = simhash.near_duplicates(odd).collect()
    want = brute.simhash(odd_rows)
    same(got, want)


def test_simhash_near_bits(spark):
    """Fingerprints in chains of one and two bits, through the tables of segments."""
    rng = random.Random(3)
    fps = set()
    for _ in range(40):
        f = rng.getrandbits(64)
        for _ in range(rng.randint(1, 6)):
            fps.add(f)
            for b in rng.sample(range(64), rng.randint(1, 3)):
                f ^= 1 << b
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    found = simhash.components(simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"))).collect()
    root = {r.node: r.root for r in found}
    label = {f: f for f in signed}
    changed = True
    while changed:
        changed = False
        for a in signed:
            for b in signed:
                if ((a ^ b) & (2**64 - 1)).bit_count() <= 2 and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    assert {f: root.get(f, f) for f in signed} == label


@pytest.mark.parametrize("small", [1, simhash.SMALL])
def test_simhash_full_buckets(spark, small):
    """All pairs within two bits, of groups that fill buckets of every width, and no others."""
    rng = random.Random(11)
    center, tight = rng.getrandbits(64), rng.getrandbits(64)
    weak = rng.sample(range(64), 9)
    fps = {rng.getrandbits(64) for _ in range(300)} | {tight ^ rng.getrandbits(8) << 3 for _ in range(200)} | {tight ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64) for _ in range(60)}
    fps |= {center ^ sum(1 << b for b in rng.sample(weak, rng.randint(0, 5))) for _ in range(200)}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    got = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), small).collect()
    want = {(a, b) for a in signed for b in signed if a > b and ((a ^ b) & (2**64 - 1)).bit_count() <= 2}
    assert len(got) == len(want) > 1000 and {tuple(r) for r in got} == want


def test_substrings(odd, odd_rows):
    got = substrings.repeated_words(odd).select("doc_id", "n_words", "n_removed", F.lower(F.hex("kept_sha256"))).collect()
    same(got, brute.substrings(odd_rows))


def test_substrings_random(spark):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(2000)]
    passages = [rng.choices(words, k=rng.randint(40, 120)) for _ in range(8)]
    rows = []
    for i in range(60):
        text = []
        for _ in range(rng.randint(0, 4)):
            p = rng.choice(passages)
            a = rng.randrange(len(p))
            text += rng.choices(words, k=rng.randint(0, 30)) + (p if rng.random() < 0.5 else p[a:]) * rng.choice((1, 1, 2))
        rows.append((i, " ".join(text)))
    got = substrings.repeated_words(spark.createDataFrame(rows, "doc_id long, text string"))
    same(got.select("doc_id", "n_words", "n_removed", F.lower(F.hex("kept_sha256"))).collect(), brute.substrings(rows))
    spans = {r.doc_id: r for r in got.collect()}
    assert all(sum(s.end - s.start for s in r.spans) == r.n_removed for r in spans.values())


def test_bpe(odd, odd_rows):
    library = Tokenizer.from_file(VOCABULARY)
    want = []
    for doc_id, text in odd_rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        want.append((doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    same(bpe.encode_digests(odd, VOCABULARY).collect(), want)
    got = bpe.encode(odd.filter("doc_id = 15"), VOCABULARY).first()
    assert got.ids == library.encode(odd_rows[18][1], add_special_tokens=False).ids and got.decoded == odd_rows[18][1]


def test_bpe_words_as_the_library(tmp_path):
    """Every character, in places where its class matters."""
    library = Tokenizer.from_file(VOCABULARY).pre_tokenizer
    for code in [*range(0x3000), *range(0x3000, 0x110000, 37)]:
        if 0xD800 <= code < 0xE000:
            continue
        c = chr(code)
        for text in (f"a{c} {c}b", f"1{c}{c} x", f"{c}'s\n{c} "):
            assert bpe.plain_words(text) == [text[a:b] for _, (a, b) in library.pre_tokenize_str(text)], text


def test_automaton_is_minimal_and_exact(tmp_path):
    rng = random.Random(2)
    words = sorted({"".join(rng.choices("abé", k=rng.randint(1, 7))) for _ in range(300)})
    vocabulary = bpe.Vocabulary(VOCABULARY)
    bpe.write_lexicon(str(tmp_path / "x"), words, vocabulary)
    lex = bpe.Lexicon(str(tmp_path / "x"))
    encoded = sorted(w.encode() for w in words)
    assert lex.look_up(encoded).tolist() == list(range(len(words)))
    others = ["", "c", "ab" * 9, "abc"]
    assert lex.look_up([w.encode() for w in others]).tolist() == [words.index(w) if w in words else -1 for w in others]
    suffixes = {frozenset(w[len(p) :] for w in encoded if w.startswith(p)) for w in encoded for p in (w[:i] for i in range(len(w) + 1))}
    assert len(lex.final) == len(suffixes)  # as many states as different sets of continuations
    for word in (b"hello", b"zzzzqqqq" * 30, "ñandú".encode()):
        ids = bpe.merge(word, vocabulary.first, vocabulary.pairs)
        assert ids == Tokenizer.from_file(VOCABULARY).encode(word.decode(), add_special_tokens=False).ids


def test_pii_base(odd, odd_rows):
    got = pii.report(odd).collect()
    want = []
    for doc_id, text in odd_rows:
        spans = brute.base_spans(text or "")
        n = Counter(k for k, _, _ in spans)
        want.append((doc_id, *(n[k] for k in pii.KINDS[:4]), hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()))
    same([tuple(r)[:6] for r in got], want)


def test_pii_random():
    rng = random.Random(1)
    for _ in range(20_000):
        text = "".join(rng.choice("019 .-+()@ab%:=\n,") for _ in range(rng.randint(0, 40)))
        assert pii.base_spans(text) == brute.base_spans(text)


def test_pii_learns_contexts(spark):
    rng = random.Random(6)
    hexes = ["".join(rng.choices("0123456789abcdef", k=40)) for _ in range(12)]
    rows = [(i, f'some words then token = "{h}" and more') for i, h in enumerate(hexes)]
    rows += [(100, 'also token = "PX-77-unseen-9" here'), (101, "the room 1234567 is free"), (102, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.report(docs).collect()}
    assert got[100] == f"id:{rows[-3][1].index('PX')}:{rows[-3][1].index('PX') + 14}" and got[101] == "" == got[102]
    masked = {r.doc_id: r.text for r in pii.mask(docs).collect()}
    assert masked[100] == 'also token = "[ID]" here' and masked[101] == rows[-2][1] and masked[102] is None


def test_avi(odd, odd_rows):
    got = {(r.doc_id, r.n_bytes, r.payload_sha256): r for r in avi.describe(avi.to_avi(odd)).collect()}
    for doc_id, text in odd_rows:
        data = (text or "").encode()
        payload = data + bytes(-len(data) % 64 or (0 if data else 64))
        r = got[doc_id, len(data), hashlib.sha256(payload).hexdigest()]
        assert (r.payload_bytes, r.tail_crc32) == (len(payload), zlib.crc32(payload[-64:]))
    clips = avi.clip_rows(avi.to_avi(odd.filter("doc_id = 9"))).orderBy("clip").collect()
    assert clips[0].start_s == 0 and all(a.end_s == b.start_s for a, b in zip(clips, clips[1:]))


def test_avi_bytes():
    rng = random.Random(5)
    for data in (b"", b"\xff" * 64, b"\xff\x00\xd0" * 50, bytes(range(256)) * 40, rng.randbytes(5000), b"x" * 4096):
        media = avi.write_avi(data)
        assert avi.Avi(media).payload() == avi.padded(data)
    flat, noise = b"\x80" * 40_960, rng.randbytes(40_960)
    assert [a for a, _ in avi.Avi(avi.write_avi(flat + noise)).clips()] == [0, 10]
    with pytest.raises(ValueError):
        avi.Avi(b"RIFFxxxxWAVE")


def coded(blocks, across, quantiser, restart, sampling):
    """A JPEG picture with these coefficients: DC prediction, runs of zeros, and Huffman codes of eight bits. ``blocks``: for each component,
    block row by block row."""
    codes, bits, units = {}, [], []
    parts = list(zip(blocks, sampling))
    out = []

    def size(v):
        return abs(v).bit_length()

    def low(v, n):
        return [(v if v >= 0 else v + (1 << n) - 1) >> i & 1 for i in range(n - 1, -1, -1)]

    wide, high = across, len(blocks[0]) // (across * sampling[0][0]) // sampling[0][1]
    for u in range(wide * high):
        unit = []
        for c, (bs, (h, v)) in enumerate(parts):
            for i in range(h * v):
                unit.append((c, bs[(u // wide * v + i // h) * wide * h + u % wide * h + i % h]))
        units.append(unit)
    symbols = []
    for n, unit in enumerate(units):
        if restart and n % restart == 0:
            before = [0] * len(parts)
            symbols.append("restart")
        elif n == 0:
            before = [0] * len(parts)
        for c, b in unit:
            d = b[0] - before[c]
            before[c] = b[0]
            symbols.append((0x00, size(d), low(d, size(d))))
            run = 0
            last = max((k for k in range(64) if b[k]), default=0)
            for k in range(1, last + 1):
                if b[k] == 0:
                    run += 1
                    if run == 16:
                        symbols.append((0x10, 0xF0, []))
                        run = 0
                else:
                    symbols.append((0x10, run << 4 | size(b[k]), low(b[k], size(b[k]))))
                    run = 0
            if last < 63:
                symbols.append((0x10, 0, []))
    tables = {t: sorted({s[1] for s in symbols if s != "restart" and s[0] == t}) for t in (0x00, 0x10)}

    def flush():
        nonlocal bits
        bits += [1] * (-len(bits) % 8)
        out.append(bytes(int("".join(map(str, bits[i : i + 8])), 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00"))
        bits = []

    marks = 0
    for i, s in enumerate(symbols):
        if s == "restart":
            if i:
                flush()
                out.append(bytes([0xFF, 0xD0 + marks % 8]))
                marks += 1
            continue
        bits += [tables[s[0]].index(s[1]) >> k & 1 for k in range(7, -1, -1)] + s[2]
    flush()
    heads = [avi.segment(0xDB, b"\0" + bytes(quantiser))]
    n = len(parts)
    heads.append(avi.segment(0xC0, avi.struct.pack(">BHHB", 8, 8 * high * sampling[0][1] - 3, 8 * wide * sampling[0][0] - 5, n) + b"".join(bytes([c + 1, h << 4 | v, 0]) for c, (h, v) in enumerate(sampling))))
    heads += [avi.segment(0xC4, bytes([t]) + bytes([0] * 7 + [len(x)] + [0] * 8) + bytes(x)) for t, x in tables.items()]
    heads.append(avi.segment(0xDD, avi.struct.pack(">H", restart)))
    heads.append(avi.segment(0xDA, bytes([n]) + b"".join(bytes([c + 1, 0]) for c in range(n)) + bytes([0, 63, 0])))
    return b"\xff\xd8" + b"".join(heads) + b"".join(out) + b"\xff\xd9"


@pytest.mark.parametrize("restart, sampling", [(0, [(1, 1)]), (3, [(1, 1)]), (0, [(2, 2), (1, 1), (1, 1)]), (2, [(2, 1), (1, 1), (1, 1)])])
def test_avi_of_any_baseline_frames(restart, sampling):
    rng = random.Random(9)
    across, high = 4, 3
    block = lambda: [rng.randint(-60, 60)] + [rng.randint(-9, 9) if rng.random() < 0.2 else 0 for _ in range(63)]
    blocks = [[block() for _ in range(across * h * high * v)] for h, v in sampling]
    quantiser = [rng.randint(1, 9) for _ in range(64)]
    data = coded(blocks, across, quantiser, restart, sampling)
    frame = avi.Frame(data, 0, len(data))
    got, wide = frame.luma()
    assert wide == across * sampling[0][0] and (got == avi.np.array(blocks[0]) * avi.np.array(quantiser)).all()
    assert frame.pixels().shape == (8 * high * sampling[0][1] - 3, 8 * wide - 5)


def test_avi_damaged_files(spark):
    whole = avi.write_avi(b"some bytes " * 900)
    files = [(1, None), (2, b""), (3, b"RIFFxxxxWAVE"), (4, whole[:200]), (5, whole[:-40]), (6, whole), (6, whole), (7, whole[:3000] + bytes(200) + whole[3200:])]
    media = spark.createDataFrame(files, "doc_id long, media binary").withColumn("error", F.lit(1))
    got = avi.describe(media).collect()
    assert len(got) == len(files) and all((r.error is None) == (r.doc_id == 6) and (r.payload_sha256 is None) == (r.doc_id != 6) for r in got)
    clips = avi.clip_rows(media).collect()
    assert {r.doc_id for r in clips if r.error} == {1, 2, 3, 4, 5, 7} and [r.start_s for r in clips if r.doc_id == 6 and r.clip == 0] == [0.0, 0.0]


def test_avi_frames_without_an_index():
    """The same frames with absolute places, and with none."""
    data = bytes(range(256)) * 60
    whole = avi.write_avi(data)
    at = whole.index(b"idx1")
    bare = b"RIFF" + avi.struct.pack("<I", at - 8) + whole[8:at]
    assert avi.Avi(bare).payload() == avi.Avi(whole).payload() == avi.padded(data)
    movi = whole.index(b"movi")
    entries = b"".join(avi.struct.pack("<4sIII", n, f, o + movi, s) for n, f, o, s in avi.struct.iter_unpack("<4sIII", whole[at + 8 :]))
    assert avi.Avi(whole[: at + 8] + entries).clips() == avi.Avi(whole).clips()


def test_language_of_other_scripts(spark):
    """Letters of every script have their own vectors: accents and alphabets tell languages apart."""
    assert len({language.letter_vector(ord(c)).tobytes() for c in "eèéñнбвßçгαβ"}) == 12
    words = {
        "ru": "река камень вечер идёт вместе город", "bg": "реката камъкът вечерта върви заедно градът", "el": "ποτάμι πέτρα βράδυ πηγαίνει μαζί πόλη", "fr": "rivière été pierre très soirée où",
        "xx": "riviere ete pierre tres soiree ou", "zh": "河流 石头 晚上 一起 城市 走路", "ja": "かわ いし ゆうがた いっしょ まち あるく",
    }
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choices(words[k].split(), k=9)), k) for i, k in enumerate(rng.choices(list(words), k=420))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language.predict(docs, language.learn(docs)).filter("held_out").collect()
    truth = {i: k for i, _, k in rows}
    assert len(got) > 50 and sum(r.lang_pred == truth[r.doc_id] for r in got) >= 0.97 * len(got)
    profiles = language.learn(docs)
    assert all(profiles.nearest(t) == profiles.predict(t)[0] for t in ["", "12", *(t for _, t, _ in rows)])


def test_language_vector_by_hand():
    """The definition, letter by letter."""
    roll = avi.np.roll
    text, v = "Où va-t-il", avi.np.zeros(language.DIMENSIONS)
    padded = " où va t il "
    grams = Counter(padded[i : i + 3] for i in range(len(padded) - 2))
    code = lambda c: language.letter_vector(0 if c == " " else ord(c)).astype(float)
    for (a, b, c), n in ((tuple(g), n) for g, n in grams.items()):
        v += n**0.5 * roll(code(a), 2) * roll(code(b), 1) * code(c)
    assert avi.np.allclose(language.vector(text), v / avi.np.linalg.norm(v), atol=1e-5)


def test_language(spark, odd, nothing):
    text = {"en": "the river and the stone walk with them this evening", "es": "el río y la piedra caminan con ellos esta tarde señor", "de": "der fluss und der stein gehen mit ihnen heute abend über"}
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choices(text[k].split(), k=12)), k) for i, k in enumerate(rng.choices(list(text), k=240))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    profiles = language.learn(docs)
    got = language.predict(docs, profiles).collect()
    truth = {i: k for i, _, k in rows}
    held = [r for r in got if r.held_out]
    assert held and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    found = {(r.doc_id, r.lang_pred): r for r in language.predict(odd, profiles).collect()}
    assert all((i, "und") in found and found[i, "und"].score == 0 for i in (1, 2, 3, 16, 17)) and (4, "und") not in found
    assert language.predict(odd, language.learn(nothing)).filter("lang_pred != 'und'").count() == 0
    assert language.keep_known(odd).count() == odd.count() - 6


@pytest.mark.parametrize("run", [simhash.near_duplicates, substrings.repeated_words, lambda d: bpe.encode_digests(d, VOCABULARY), pii.report, lambda d: avi.describe(avi.to_avi(d)), lambda d: language.predict(d, language.learn(d)), simhash.keep_one, pii.mask])
def test_empty_tables(nothing, run):
    assert run(nothing).count() == 0
