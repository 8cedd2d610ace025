from __future__ import annotations

import random
import re
import unicodedata

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridloom.llm import language, leak, mix

# ---------------------------------------------------------------- leaks


def longest_common(a, b):
    best = 0
    for i in range(len(a)):
        for j in range(len(b)):
            n = 0
            while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                n += 1
            best = max(best, n)
    return best


@pytest.mark.parametrize("seed", range(15))
def test_automaton_against_brute_force(seed):
    rng = random.Random(seed)
    items = [(k, [rng.choice("abc") for _ in range(rng.randint(0, 14))]) for k in range(6)]
    items.append((9, list(items[0][1])))
    automaton = leak.SuffixAutomaton(items, 3)
    for _ in range(40):
        text = [rng.choice("abcd") for _ in range(rng.randint(0, 25))]
        want = {k: n for k, w in items if (n := longest_common(w, text)) >= 3}
        assert automaton.holders(text) == want


ITEM = "Khi so hai bản kê thì độ phẳng bề mặt tại chân mái dốc giảm từ 325 xuống 584 trong khi giằng móng vẫn giữ nguyên."


def test_leaks(spark):
    spoiled = unicodedata.normalize("NFD", ITEM.upper()).replace(" ", "\n ", 3).replace("I ", "I​ , ")
    half = " ".join(ITEM.split()[4:18])
    short = " ".join(ITEM.split()[4:17])
    rows = [(1, "x " + ITEM + " y"), (2, spoiled), (3, half), (4, short), (5, None), (6, ""), (1, "x " + ITEM + " y"), (7, "từ " * 50_000 + half)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"words": F.lit(1), "item_id": F.lit("mine")})
    items = spark.createDataFrame([(10, ITEM), (11, ITEM), (12, "quá ngắn"), (13, None), (None, ITEM)], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in leak.leaked_items(docs, items).distinct().collect()}
    assert got == {(d, i) for d in (1, 2, 3, 7) for i in (10, 11)}
    assert {(r.doc_id, r.item_id) for r in leak.leaked_items(docs, items, block_words=20).distinct().collect()} == got
    assert leak.leaked_items(docs, items.limit(0)).count() == 0 and leak.leaked_items(docs.limit(0), items).count() == 0
    clean = {r.doc_id: (r.text, r.removed_words) for r in leak.without_leaks(docs, items).collect()}
    assert clean[1] == ("", len(leak.words(ITEM))) and clean[4] == (short, 0) and clean[5] == (None, 0)
    assert clean[7][0].startswith("từ từ") and clean[7][1] == 14
    assert leak.leaked_items(leak.without_leaks(docs, items), items).count() == 0


# ---------------------------------------------------------------- languages

SAMPLE = {
    "vi": ["Chủ đầu tư đã hoàn thành việc gia công lan can tại sàn tầng bảy.", "Sau khi đo lại, phần dây điện còn tồn được ghi vào nhật ký.", "Bộ phận vật tư yêu cầu bổ sung chứng chỉ của xi măng rời."],
    "en": ["The main contractor finished the blinding concrete at the gate.", "After measuring again, the stock of plywood is listed in the diary.", "Please ask the supplier to reply in writing before the end."],
    "fr": ["Le bureau de contrôle a terminé les travaux de terrassement.", "Il faut vérifier les niveaux avant de poursuivre la pose.", "Nous prions le magasinier de répondre par écrit avant demain."],
    "de": ["Der Lieferant hat die Arbeit an der Schalung abgeschlossen.", "Wegen des Regens ruhte die Arbeit an den Rohren mehrere Stunden.", "Bitte antworten Sie schriftlich, damit das Lager weiterarbeiten kann."],
    "ja": ["資材係は四月までに書面で回答してください。", "現場監督は基礎の鉄筋を確認しました。", "雨のため配管の作業を止めました。"],
    "zh": ["施工单位已经完成了基础的钢筋工程。", "请供应商在月底之前书面答复。", "由于下雨管道施工停止了几个小时。"],
}


@pytest.fixture(scope="module")
def model():
    sample = pd.DataFrame([(" ".join(t), code) for code, t in SAMPLE.items()] + [(SAMPLE["vi"][0], "en")], columns=["text", "lang"])
    return language.fit_centroids(sample)


def test_segments(model):
    vi, en, ja = ("".join(f"{s} " for s in SAMPLE[c]).strip() for c in ("vi", "en", "ja"))
    bare = language.strip_accents(vi)
    text = f"Tiêu đề\n\n{vi}\n\n1. trial piling | 5,1\n\n{en} {vi}"
    segments = language.segment_texts([text, ja, bare, None, "", "12 %", "défaut"], model)
    assert [(s["lang"], s["sentences"]) for s in segments[0]] == [("vi", 3), ("en", 3), ("vi", 3)]
    assert segments[0][0]["start_char"] == 0 and segments[0][-1]["end_char"] == len(text)
    assert [s["lang"] for s in segments[1]] == ["ja"] and [s["lang"] for s in segments[2]] == ["vi"]
    assert segments[3] == segments[4] == []
    assert all(0 <= s["confidence"] <= 1 for own in segments for s in own)


def test_held_out_accuracy(spark, data):
    docs = spark.read.parquet(f"{data}/../sf0.01/documents.parquet").select("doc_id", "text", language.label_language(F.col("lang")).alias("lang")).toPandas()
    docs = docs[docs.lang.isin(language.LANGUAGES)].drop_duplicates("text")
    train, test = docs[docs.doc_id % 2 == 0], docs[docs.doc_id % 2 == 1]
    train = train.groupby("lang").head(60)
    fitted = language.fit_centroids(train)
    got = []
    for own in language.segment_texts(list(test.text), fitted):
        size = {}
        for s in own:
            size[s["lang"]] = size.get(s["lang"], 0) + s["end_char"] - s["start_char"]
        got.append(max(size, key=size.get))
    assert np.mean(np.array(got) == test.lang.to_numpy()) > 0.9  # labels themselves are partly wrong


def test_sentences():
    text = "Câu một dài 4,7 m². Câu hai\nnối dòng tiếp theo.\n1. thử cọc | 5,1\n\nThe end"
    assert [text[a:b].strip() for a, b in language.sentences(text)] == ["Câu một dài 4,7 m².", "Câu hai\nnối dòng tiếp theo.", "1. thử cọc | 5,1", "The end"]
    assert language.is_complete("Câu hai nối dòng.") and not language.is_complete("Tiêu đề ngắn") and not language.is_complete("nối dòng tiếp theo đây.")


_END = re.compile(r"(?:[.!?…]+[\"'”’»)\]]*|[。！？]+[」』）]*)$")


def plain_sentences(text):
    """Places and completeness of the sentences, by patterns."""
    out = []
    for block in re.finditer(r"[^\n\r]+(?:\r?\n(?!\s*[\r\n]|\s*(?:\d+[.)]|[-*•|#])\s)[^\n\r]+)*", text):
        at = block.start()
        for m in re.finditer(r"(?:[.!?…]+[\"'”’»)\]]*(?=\s|$)|[。！？]+[」』）]*)", block.group()):
            if not re.fullmatch(r"\s*\d{1,3}", text[at : block.start() + m.start()]):
                out.append((at, block.start() + m.end()))
                at = block.start() + m.end()
        if text[at : block.end()].strip():
            out.append((at, block.end()))

    def complete(s):
        first = next((c for c in s if c.isalnum()), "")
        enough = len(s.split(None, 4)) >= 4 or len(re.findall("[\u3040-\u9fff]", s)) >= 6
        return "|" not in s and bool(_END.search(s)) and not first.islower() and enough

    return [(a, b, complete(text[a:b])) for a, b in out]


@pytest.mark.parametrize("seed", range(60))
def test_sentences_against_patterns(seed):
    rng = random.Random(seed)
    parts = ["Câu", "hai", "B", "12", "3", "1.", "4)", "-", "#", "|", "•", ".", "!", "…", "?", "。", "！", "」", ")", "”", "漢字", "かな", " ", " ", "\n", "\r\n", "\r", "\n\n", "\t", "\u3000", "😀", "ß", ","]
    for _ in range(60):
        text = "".join(rng.choice(parts) + (" " if rng.random() < 0.4 else "") for _ in range(rng.randint(0, 40))) + "x"
        start, stop, complete = language.split_sentences(language._codes(text + "\n"))
        assert list(zip(start.tolist(), stop.tolist(), complete.tolist(), strict=True)) == plain_sentences(text)


def test_vectors_against_plain_counts():
    texts = ["Bê tông, bê TÔNG 12 a😀b", "", "漢字かな交じり文", " ", "l'eau", "é" + "e\u0301"]
    number, term, count = language._terms(texts)
    for k, t in enumerate(texts):
        want: dict[str, int] = {}
        for w in language._plain(t).split():
            padded = f" {w} "
            threes = [padded[i : i + 3] for i in range(len(padded) - 2) if max(padded[i : i + 2]) < "\u2e80"]
            for g in [*(c for c in w if c >= "\u2e80"), *(padded[i : i + 2] for i in range(len(padded) - 1)), *threes]:
                want[g] = want.get(g, 0) + 1
        # equal but for n-grams that share a number
        assert count[number == k].sum() == sum(want.values()) and abs(len(want) - (number == k).sum()) <= 1
    assert len(set(term[number == 0]) & set(term[number == 2])) == 0


FOREIGN = [
    "El contratista principal terminó el hormigón de limpieza en la entrada.", "Debido a la lluvia, los trabajos se detuvieron durante varias horas.", "Las muestras fueron aprobadas con condiciones por el laboratorio.",
    "De hoofdaannemer heeft het werkvloerbeton bij de poort voltooid.", "Vraag de leverancier om voor het einde van de maand schriftelijk te antwoorden.", "Het bedrijf leverde twaalf ton grind naast de brug.",
    "Główny wykonawca zakończył betonowanie przy bramie wjazdowej.", "Z powodu deszczu prace przy rurach zostały wstrzymane na kilka godzin.", "Firma dostarczyła dwanaście ton żwiru obok mostu.",
    "Si prega di chiedere al fornitore di rispondere per iscritto entro la fine del mese.", "A causa della pioggia i lavori sulle tubazioni sono rimasti fermi per alcune ore.", "La ditta ha consegnato dodici tonnellate di ghiaia accanto al ponte.",
    "O empreiteiro principal concluiu o betão de limpeza junto ao portão.", "Генеральный подрядчик завершил бетонные работы у ворот.", "주계약자는 정문에서 콘크리트 작업을 완료했습니다.",
]


def test_rejection(spark, data):
    docs = spark.read.parquet(f"{data}/../sf0.01/documents.parquet").select("doc_id", "text", "lang")
    fitted = language.fit_centroids(language.training_sample(docs), idf=language.term_weights(docs))
    cosines = fitted.cosines(FOREIGN)
    assert np.mean(cosines.max(1) < fitted.least[cosines.argmax(1)]) > 0.9
    texts = [r.text for r in docs.where("text IS NOT NULL").collect()]
    own = fitted.cosines([s for t in texts for s in language.complete_sentences(t)])
    assert np.mean(own.max(1) < fitted.least[own.argmax(1)]) < 0.01
    vi = " ".join(language.complete_sentences(max(texts, key=lambda t: sum(c in "ạảấầậ" for c in t)))[:3])
    spanish = " ".join(FOREIGN[:3])
    got = language.segment_texts([f"{vi}\n\n{spanish}\n\n{vi}", spanish, f"{vi} {FOREIGN[6]} {vi}"], fitted)
    assert [s["lang"] for s in got[0]] == ["vi", "und", "vi"] and [s["lang"] for s in got[1]] == ["und"] and [s["lang"] for s in got[2]] == ["vi"]
    assert got[0][1]["sentences"] == 3 and got[0][1]["confidence"] == 0 and got[2][0]["sentences"] == 6


def test_labels(spark):
    labels = {"vi": "vi", "VI": "vi", "vi-VN": "vi", "vie": "vi", "Vietnamese": "vi", " English ": "en", "eng": "en", "fr-FR": "fr", "de-DE": "de", "jpn": "ja", "zh-CN": "zh", "es": "es", "": None, "unknown": None, "und": None, None: None}
    df = spark.createDataFrame([(k,) for k in labels], "l string").withColumn("c", language.label_language(F.col("l")))
    assert {r.l: r.c for r in df.collect()} == labels


def test_language_operator(spark, model):
    vi, en = " ".join(SAMPLE["vi"]), " ".join(SAMPLE["en"])
    rows = [(1, vi, "vi"), (2, en, "vi"), (3, vi + "\n\n" + en, None), (4, None, "vi"), (5, "", "en"), (6, vi + "\n\n" + SAMPLE["en"][0], "vi"), (2, en, "vi"), (7, vi * 200, "es")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").withColumns({"segments": F.lit(1), "named": F.lit("x")})
    got = {(r.doc_id, r.lang) for r in language.unlabelled_languages(docs, model=model).collect()}
    assert got == {(2, "en"), (3, "vi"), (3, "en"), (7, "vi")}
    whole = {r.doc_id: r for r in language.document_languages(docs, model=model).collect()}
    assert whole[2].lang == "en" and whole[4].lang == "und" and whole[4].confidence == 0.0
    empty = docs.limit(0)
    assert language.unlabelled_languages(empty).count() == 0


# ---------------------------------------------------------------- mixing


def test_pivotal_rounding_keeps_mass_and_expectation():
    rng = np.random.default_rng(1)
    size, fraction = rng.integers(1, 500, 400), rng.random(400)
    mean = np.zeros(400)
    for seed in range(300):
        p, left = mix.round_pivotal(fraction, size, seed)
        assert np.isclose((p * size).sum(), (fraction * size).sum())
        assert ((p > 0) & (p < 1)).sum() == (left >= 0) <= 1
        mean += p
    assert np.abs(mean / 300 - fraction).mean() < 0.03


def test_mix(spark):
    rng = random.Random(3)
    rows = [(i, "từ " * rng.randint(1, 60), rng.choice(["big", "big", "big", "small"])) for i in range(1200)]
    rows += [(5000, None, "big"), (5001, "", "small"), (5002, "x y", None), rows[0], (None, "a", "big")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumns({"n_tokens": F.lit(1), "copies": F.lit("x")})
    plan = [("p", "big", 0.5, 2, 0.6), ("p", "small", 0.45, 2, 0.6), ("p", "gone", 0.05, 3, 0.6), ("q", "small", 1.0, 3, 5.0), (None, "big", 1.0, 1, 1.0)]
    targets = spark.createDataFrame(plan, "plan_name string, source string, target_share double, max_repeats int, size_ratio double")
    old = mix.BUCKET_ROWS, mix.FAN_IN
    mix.BUCKET_ROWS, mix.FAN_IN = 50, 3
    try:
        mixed, rates = mix.mix(docs, targets)
        got = {(r.plan_name, r.doc_id): (r.copies, r.n_tokens) for r in mixed.collect()}
        again = {(r.plan_name, r.doc_id): (r.copies, r.n_tokens) for r in mix.mix(docs.repartition(7), targets)[0].collect()}
    finally:
        mix.BUCKET_ROWS, mix.FAN_IN = old
    assert got == again
    shares = {(r.plan_name, r.source): r for r in mix.reached_shares(mixed, rates).collect()}
    most = max(n for _, n in got.values())
    big = shares["p", "big"]
    assert abs(big.tokens - big.target_tokens) <= most and big.most_copies <= 2
    assert shares["p", "gone"].tokens == 0 and shares["q", "small"].most_copies == 3
    assert np.isclose(sum(r.reached_share for k, r in shares.items() if k[0] == "p"), 1)
    assert mix.mix(docs.limit(0), targets)[0].count() == 0 and mix.mix(docs, targets.limit(0))[0].count() == 0


def test_term_weights_count_all_documents(spark):
    texts = [" ".join(SAMPLE["vi"]), " ".join(SAMPLE["en"]), " ".join(SAMPLE["en"]), None, ""]
    documents = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(3)
    every = [language._plain(t[a:b]) for t in texts if t for a, b in language.sentences(t)]
    df = np.bincount(language._terms(every)[1], minlength=language.DIMENSIONS)
    idf = language.term_weights(documents)
    assert np.allclose(idf, np.log((1 + len(every)) / (1 + df)) + 0.1)
    sample = pd.DataFrame([(" ".join(SAMPLE["vi"]), "vi")], columns=["text", "lang"])
    assert np.array_equal(language.fit_centroids(sample, idf=idf).idf, idf)
