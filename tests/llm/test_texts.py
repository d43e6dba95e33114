"""Token ids, leaked passages and garbled text against references and odd input."""

from __future__ import annotations

import os
import random

import numpy as np
import pytest

from larkspur.llm import leaks, mojibake, tokens
from larkspur.llm.tokens import Encoder

VOCABULARY = f"{tokens.VOCABULARIES}/byte_bpe_50k.tiktoken"
needs_vocabulary = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary here")
ALPHABET = " \n\t' 　 stremdvlx S5٣.!'é漢ñ²Ⅷ​\x85😀"


def odd_texts(n):
    rng = random.Random(1)
    out = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 40))) for _ in range(n)]
    return [*out, "", " ", "\n\n", "'s", "a's b", "I'd've  done  it'll ", "x" * 50000, "word " * 30000, "5's ''s 's's"]


@needs_vocabulary
def test_ids_equal_the_reference_library():
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(f"{tokens.VOCABULARIES}/byte_bpe_50k.json")
    reference.encode_special_tokens = True
    texts = odd_texts(3000)
    ids, per_text, _ = Encoder(VOCABULARY).encode(texts)
    got = [x.tolist() for x in np.split(ids, np.cumsum(per_text)[:-1])]
    assert got == [e.ids for e in reference.encode_batch(texts, add_special_tokens=False)]


@needs_vocabulary
def test_encode_rows(spark):
    rows = [(1, "hello world"), (2, None), (3, ""), (3, ""), (None, "é"), (4, "hello world")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as ids", "2 as key")
    got = tokens.encode(df, offsets=True).collect()
    by_key = {}
    for r in got:
        by_key.setdefault(r.doc_id, []).append((r.ids, r.offsets))
    assert len(got) == len(rows) and by_key[2] == [([], [])] and by_key[3] == [([], [])] * 2
    assert by_key[1] == by_key[4] and by_key[1][0][1] == [0, 5]
    assert tokens.encode(df.limit(0)).count() == 0


@needs_vocabulary
def test_offsets_cut_the_text():
    text = "naïve  café 42 don't"
    other = "zwei"
    ids, per_text, at = Encoder(VOCABULARY).encode([other, "", text])
    assert per_text.tolist()[1] == 0 and at[0] == 0 and at[per_text[0]] == 0
    tokens_of = {r: t for t, r in tokens.Merger(VOCABULARY).ranks.items()}
    data, mine = text.encode(), slice(int(per_text[0]), None)
    for i, a in zip(ids[mine].tolist(), at[mine].tolist()):
        assert data[a : a + len(tokens_of[i])] == tokens_of[i]
    assert b"".join(tokens_of[i] for i in ids[mine].tolist()) == data


@needs_vocabulary
def test_merging_equals_the_reference_library():
    import tiktoken

    merger = tokens.Merger(VOCABULARY)
    whole = tiktoken.Encoding("own", pat_str=r"(?s).+", mergeable_ranks=merger.ranks, special_tokens={})
    rng = random.Random(4)
    pieces = ["aaaaaaa", "xx" * 400, "所述控制器根据权利要求连接到传感器" * 20, " unbelievable", "\n\n\n", "=" * 70]
    pieces += ["".join(rng.choice("abcdeéя漢 0-") for _ in range(rng.randint(1, 90))) for _ in range(400)]
    ids, lengths = merger.merge([p.encode() for p in pieces])
    assert [x.tolist() for x in np.split(ids, np.cumsum(lengths)[:-1])] == [whole.encode_ordinary(p) for p in pieces]
    assert all(merger._long(p.encode()) == whole.encode_ordinary(p) for p in pieces)


WORDS = [f"w{i}" for i in range(400)]
ITEMS = [
    (1, " ".join(WORDS[0:60]), "en"),
    (2, " ".join(WORDS[100:170]), "en"),
    (3, " ".join(WORDS[100:170]), "en"),
    (4, " ".join(WORDS[200:212]), "en"),
    (5, None, "en"),
    (6, "", None),
    (7, "short one", "de"),
]


def leak(spark, docs):
    items = spark.createDataFrame(ITEMS, "item_id long, text string, lang string").selectExpr("*", "1 as doc_id", "2 as gram")
    rows = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as item_id", "2 as words")
    return sorted(map(tuple, leaks.find_leaks(rows, items).collect()))


def changed(words, at):
    return [f"other{i}" if i in at else w for i, w in enumerate(words)]


def test_leaks_whole_part_and_edited(spark):
    filler = " ".join(f"f{i}" for i in range(300))
    passage = WORDS[10:30]
    docs = [
        (1, f"{filler} {' '.join(WORDS[0:60])} {filler}"),
        (2, " ".join(passage)),
        (3, " ".join(changed(passage, {6, 13}))),
        (4, " ".join(changed(passage, {5, 9, 13}))),
        (5, " ".join(WORDS[10:29])),
        (6, " ".join(WORDS[120:150]).upper()),
        (7, "<p>" + ".\n".join(w[0] + "​" + w[1:] for w in WORDS[100:130]) + "</p>"),
        (8, " ".join(WORDS[200:212])),
        (9, None),
        (10, ""),
        (11, " ".join([*passage[:8], "added", *passage[8:16], *passage[17:]])),
        (1, "repeated key"),
        (12, filler * 200),
    ]
    assert leak(spark, docs) == [(1, 1), (2, 1), (3, 1), (6, 2), (6, 3), (7, 2), (7, 3), (8, 4), (11, 1)]
    assert leak(spark, docs[8:10]) == []


def test_symbols_and_references(model):
    """One symbol in a word that is common otherwise, and characters behind references."""
    often = mojibake.train([f"at 12 °C the valve’s {i}–{i + 3} µm gap" + (" naïve" if i == 3 else "") for i in range(40)] + CLEAN * 3)
    judge = mojibake.Judge(often)
    for clean, chain in (("12 °C", (("cp850", "cp1252"),)), ("valve’s", (("cp1252", "mac_roman"),)), ("7–9", (("cp1252", "cp437"),))):
        bad = mojibake.garble(clean, chain)
        assert judge.slab([bad, clean]).tolist() == [True, False] and judge.restore(f"see {bad} here")[0] == f"see {clean} here"
    bad = "a&#226;&#8364;&#8220;b and &lt;p&gt; at 5 &#176;C"
    assert judge.slab([bad, "at 5 &#176;C &lt;b&gt; &#8211; &eacute;t&eacute;"]).tolist() == [True, False]
    assert judge.restore(bad)[0] == "a–b and &lt;p&gt; at 5 &#176;C"


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.001/documents.parquet"), reason="no test data here")
def test_planted_words_are_found_and_restored():
    """Words of documents that the model wasn't trained on, garbled by every chain."""
    import pyarrow.parquet as pq

    rows = pq.read_table("/root/testdata/sf0.01/documents.parquet").select(["doc_id", "text"]).to_pylist()
    texts = [r["text"] for r in sorted(rows, key=lambda r: r["doc_id"]) if r["text"]]
    judge = mojibake.Judge(mojibake.train([t[: mojibake.TRAIN_CHARS] for t in texts[::2]]))
    held = [t for t, bad in zip(texts[1::2], judge.slab(texts[1::2])) if not bad]
    rng = random.Random(3)
    tried = found = exact = restored = 0
    for text in held[:150]:
        words = [w for w in dict.fromkeys(mojibake.WORD.findall(text)) if 1 < len(w) < 30]
        for word in rng.sample(words, min(1, len(words))):
            for chain in mojibake.CHAINS:
                bad = mojibake.garble(word, chain)
                if bad is None or bad == word or mojibake.WORD.fullmatch(bad) is None:
                    continue
                tried += 1
                verdict = judge.words([mojibake.DIGIT.sub("0", bad)])[0]
                found += verdict is not None
                if mojibake.invert(bad, chain) == word:
                    exact += 1
                    restored += judge.restore(f"x {bad} y")[0] == f"x {word} y"
    assert tried > 1000 and found >= 0.95 * tried and restored >= 0.9 * exact


def test_short_and_repetitive_items(spark):
    """An item of four words, of one, and one that repeats itself (9 different words)."""
    items = [
        (1, "en", "Bleed the brake circuit"),
        (2, "en", "open the main valve now " * 6),
        (3, "en", "Zyzzyva"),
        (4, "en", " ".join(WORDS[:40])),
        (5, "en", "..."),
    ]
    docs = [
        (1, "then <b>bleed</b> the brake-circuit. Then bleed the brake circuit!"),
        (2, "x y z " + "open the main valve now " * 6 + "and so on"),
        (3, "a ZYZZYVA stands here"),
        (4, " ".join(WORDS[:5])),
        (5, "bleed the front brake circuit"),
    ]
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    got = leaks.find_leaks(rows, spark.createDataFrame(items, "item_id long, lang string, text string"))
    assert sorted(map(tuple, got.collect())) == [(1, 1), (2, 2), (3, 3)]


def test_slots_of_reparameterised_items(spark):
    words = [f"alpha{i}" for i in range(30)]
    words[2::4] = ["40"] * 7
    same = [{"40": "55"}.get(w, w) for w in words]
    mixed = [f"5{i // 4}" if w == "40" else w for i, w in enumerate(words)]
    items = spark.createDataFrame([(1, "en", " ".join(words))], "item_id long, lang string, text string")
    rows = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(same)), (3, " ".join(mixed))], "doc_id long, text string")
    assert [r.doc_id for r in leaks.find_leaks(rows, items).collect()] == [1]
    assert sorted(r.doc_id for r in leaks.find_leaks(rows, items, renamed=True).collect()) == [1, 2]


def test_words_ignore_variants():
    plain = leaks.words_of("the self-aligning café of Straße ﬁne")
    assert plain == leaks.words_of("THE  self‐\naligning café of <b>STRASSE</b>, ﬁ­ne".replace("ﬁ­ne", "fi­ne"))


def test_passage_limits():
    item = [f"a{i}" for i in range(60)]
    assert leaks.holds_passage(item[5:25], item) and not leaks.holds_passage(item[5:24], item)
    assert leaks.holds_passage([*item[5:15], "x", *item[16:25]], item)
    assert not leaks.holds_passage([*item[5:10], "x", "y", "z", *item[13:25]], item)
    assert leaks.holds_passage([*item[5:12], "x", "y", *item[12:25]], item)
    assert not leaks.holds_passage([*item[5:12], "x", "y", "z", *item[12:25]], item)
    assert leaks.holds_passage([*item[0:30], "x", "y", "z", *item[33:60]], item)
    assert leaks.holds_passage(["".join(item[5:7]), *item[7:40]], item)
    assert not leaks.holds_passage([], item) and not leaks.holds_passage(item, [])


CLEAN = [
    "Der Läufer prüft das Gehäuse über der Öffnung und führt den Stößel gemäß Vorschrift für größere Kühlelemente.",
    "La pièce fermée dépasse la première étape, réalisée à température élevée près du vérin étanche.",
    "Клапан закрыт, корпус показан на фигуре и описывает давление подшипника в устройстве.",
    "所述控制器根据权利要求连接到传感器，用于测量温度。",
    "前記弁体は回転軸に取り付けられ、圧力により移動する。",
    "El émbolo está próximo al cárter según la reivindicación número nueve, diseñado también así.",
    "a tolerance of 12 ± 0.4 µm, “outer” – it’s ≥ 5 °C and 3 m²/s",
]
CASES = [c for c in mojibake.CHAINS if c[0][0] in ("utf-8", "cp1251", "gb18030", "euc_jp") and "lower" not in c[0][1]]


@pytest.fixture(scope="module")
def model():
    rng = random.Random(5)
    texts = []
    for _ in range(400):
        t = rng.choice(CLEAN)
        words = t.split(" ")
        texts.append(" ".join(rng.sample(words, len(words))))
    return mojibake.train(texts)


def test_chains_are_found_and_inverted(model):
    judge = mojibake.Judge(model)
    tried = found = right = 0
    for text in CLEAN:
        for chain in CASES:
            bad = mojibake.garble(text, chain)
            if bad is None or bad == text or "�" in bad:
                continue
            tried += 1
            found += bool(judge.slab([bad])[0])
            if mojibake.invert(bad, chain) == text and not mojibake.MARKS.search(bad):
                right += judge.restore(bad)[0] == text
    assert tried > 60 and found >= 0.9 * tried and right >= 10


def test_clean_text_is_no_case(model):
    judge = mojibake.Judge(model)
    odd = ["T o u t = ∑ x ? □", "symbol  glyph", "plain ascii", "", "Þórdís ðæl", "Θ, λ and Δ", "½ inch ├── x"]
    assert not judge.slab([*CLEAN, *odd]).any()


def test_one_word_is_enough_and_rows(spark, model):
    docs = [
        (1, "long clean text " * 5000 + " das GehÃ¤use " + "more " * 100),
        (2, "clean"),
        (3, None),
        (4, ""),
        (5, "broken � mark"),
        (6, "c1 \x93quoted\x94"),
    ]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as key")
    assert sorted(r[0] for r in mojibake.find_garbled(df, model=model).collect()) == [1, 5, 6]
    assert mojibake.find_garbled(df.limit(0)).count() == 0


def test_words_that_do_not_decode_whole_are_restored_in_parts(model):
    judge = mojibake.Judge(model)
    for text in CLEAN[3:5]:
        bad = text.encode().decode("gbk", "replace")
        assert "�" in bad
        restored, chains, lost = judge.restore(bad)
        kept = sum(c in text for c in restored)
        assert kept >= 0.6 * len(text) and kept > 3 * sum(c in text for c in bad)
        assert 0 < lost <= bad.count("�")
        assert [mojibake.CHAINS[c] for c in chains] == [(("utf-8", "gb18030"),)]
        # What is clean beside it stays.
        assert judge.restore(f"{bad} {text}")[0] == f"{restored} {text}"
    # Words with C1 controls aren't tied to the chain of the others.
    german = CLEAN[0] + " Stößel"
    restored, _, lost = judge.restore(german.encode().decode("latin-1"))
    assert restored == german and lost == 0
    assert judge.restore("broken � mark") == ("broken � mark", [], 1)


def test_a_garbled_part_of_a_run_is_a_case(model):
    judge = mojibake.Judge(model)
    cases = {
        "„fÃ¼hrt“": "„führt“",
        "«\xa0Ã©tÃ©\xa0»": "«\xa0été\xa0»",
        "éÃ¼ber": "éüber",
        "所述控制器fÃ¼hrt连接到传感器，用于测量温度": "所述控制器führt连接到传感器，用于测量温度",
        "前記弁体は" + "圧力".encode().decode("gb18030") + "回転軸に取り付けられ": "前記弁体は圧力回転軸に取り付けられ",
    }
    assert judge.slab(list(cases)).all()
    assert not judge.slab(list(cases.values())).any()
    for bad, good in cases.items():
        assert judge.restore(bad)[0] == good
