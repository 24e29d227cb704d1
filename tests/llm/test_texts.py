import base64
import os
import random

import pytest
from lodequery.llm import abuse, encoding, encoding_repair, languages, site_lines
from pyspark.sql import functions as F

FILE = os.path.join(encoding.TOKENIZERS, encoding.BYTE_BPE)


@pytest.mark.skipif(not os.path.exists(FILE), reason="needs the vocabulary file")
def test_encoding_matches_the_library(spark):
    tiktoken = pytest.importorskip("tiktoken")
    with open(FILE, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    known = tiktoken.Encoding("x", pat_str=encoding.SPLIT_PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(2)
    texts = [None, "", " ", "it's the world's  best   \n\n text", "a" * 3000, "ab" * 900, "é漢字😀" * 300, "​x", "<|endoftext|>", "x" * 513]
    texts += ["".join(rng.choice("etaoin shrdlu\n0") for _ in range(rng.randrange(2000))) for _ in range(20)]
    texts += ["".join(chr(rng.randrange(32, 0x3000)) for _ in range(300)) for _ in range(10)] + ["".join(rng.choice("aetx") for _ in range(4000))]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, ids int")
    got = {r.doc_id: r.ids for r in encoding.encode_texts(docs).collect()}
    assert got == {i: known.encode_ordinary(t) if t else [] for i, t in enumerate(texts)}
    counts = {r.doc_id: r.tokens for r in encoding.token_counts(docs).collect()}
    assert counts == {i: len(x) for i, x in got.items()}


PROSE = {
    "en": "It isn’t obvious why the naïve reader prefers a café on the corner. The engine — unlike others — keeps its own list of pages.",
    "de": "Später prüft das Wörterbuch jede Überschrift für die nächste Übersicht. Der schöne Käfer läuft über die Straße und überquert große Plätze.",
    "fr": "L’équipe répète les requêtes après une brève pause. Le moteur protège déjà les résultats où la tête du réseau était fermée à côté.",
    "es": "La revisión señala los párrafos largos según el índice más pequeño. También publica el artículo del año y la canción de mañana.",
    "pt": "A verificação não atrasa as ligações até à próxima edição. O índice também contém informações e opções que são úteis à redação.",
    "ru": "Поисковая система собирает длинные абзацы и проверяет каждый заголовок страницы. Словарь хранит редкие слова и порядок слов.",
}


def _scores():
    return encoding_repair.PairScores(*encoding_repair.pair_counts([p for p in PROSE.values() for _ in range(40)]))


@pytest.mark.parametrize("lang,was,read", [("de", "utf-8", "cp1252"), ("fr", "utf-8", "latin-1"), ("es", "utf-8", "cp1250"), ("pt", "utf-8", "mac_roman"), ("ru", "utf-8", "cp1251"), ("de", "cp1252", "cp850"), ("es", "cp1252", "mac_roman"), ("ru", "cp1251", "latin-1")])
def test_round_trip_of_damage(lang, was, read):
    text = PROSE[lang]
    raw = text.encode(was)
    damaged = "".join(bytes([b]).decode(read, "ignore") or chr(b) for b in raw)
    restored, runs, whole = encoding_repair.repair(damaged, _scores())
    assert runs and whole and restored == text


def test_what_is_not_damage(spark):
    scores = _scores()
    sample = PROSE["en"] + " The note prints “â€™” to show it. ½ cup, x²+y², №, 索引, 😀"
    assert encoding_repair.repair(sample, scores)[1] == 0
    assert encoding_repair.repair("wei� genau “�”", scores)[1:] == (1, False)
    rows = [(i, "t", p, 0) for i, p in enumerate(list(PROSE.values()) * 900)]
    rows += [(10_000, PROSE["de"].encode().decode("latin-1"), None, 0), (10_001, None, PROSE["fr"].encode().decode("latin-1"), 0), (None, "Ã©t", "", 0), (10_002, "", "", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, title string, content_text string, runs int")
    found = {(r.doc_id, r.field): r.original for r in encoding_repair.garbled_fields(docs).collect()}
    assert found == {(10_000, "title"): PROSE["de"], (10_001, "content_text"): PROSE["fr"]}
    assert encoding_repair.garbled_fields(docs.where("false")).count() == 0


def test_language_of_held_out_lines():
    texts = {k: [v] for k, v in PROSE.items()}
    table = languages.Prototypes(texts).table()
    lines = ["Der Hund läuft durch den Garten und bellt laut", "the dogs run through the garden and bark", "le chien court dans le jardin avec les enfants",
             "los perros corren por el jardín con los niños", "os cães correm pelo jardim com as crianças não", "собака бежит по саду и громко лает на людей"]
    sizes, scores = languages.score_lines(lines, table)
    assert [languages.LANGUAGES[k] for k in scores.argmax(axis=1)] == ["de", "en", "fr", "es", "pt", "ru"]
    assert languages.score_lines(["", "1 2"], table)[1].sum() == 0 and languages.score_lines([], table)[0].size == 0


def test_labels(spark):
    labels = {"EN": "en", "en_GB": "en", "eng": "en", "English": "en", "xx": None, "": None, None: None, "nl": None, " pt-BR ": "pt", "German": "de"}
    rows = spark.createDataFrame([(k,) for k in labels], "l string").select("l", languages.named_column(F.col("l")).alias("n")).collect()
    assert {r.l: r.n for r in rows} == labels and {k: languages.named_language(k) for k in labels} == labels


def test_wrong_labels(spark):
    body = {k: "\n".join([v, v, v]) for k, v in PROSE.items()}
    rows = [(1, "en", body["en"]), (2, "de", body["en"]), (3, None, body["fr"]), (4, "ru", body["ru"] + "\n" + PROSE["es"]), (5, "de", "kurz"), (6, "en", None), (7, "pt", ""), (None, "en", body["de"])]
    rows += [(100 + 10 * k + j, lang, text) for k, (lang, text) in enumerate(body.items()) for j in range(5)]
    docs = spark.createDataFrame([(i, f"https://h.example/{i}", "", t, l) for i, l, t in rows], "doc_id long, url string, title string, content_text string, lang string")
    assert {tuple(r) for r in languages.wrong_labels(docs).collect()} == {(2, -1, "en"), (3, -1, "fr"), (4, 3, "es")}
    assert languages.wrong_labels(docs.where("false")).count() == 0


ABUSIVE = [
    "You are nothing but a stupid l o s e r.", "hey ASSHOLE, kiss my ass!", "Drop dead, you piece of sh*t", "verpiss dich, du Abschaum", "tu es un pauvre c0nn4rd, sale merde", "cállate, imbbbbécil de m.i.e.r.d.a",
    "Você é um idiota nojento", "Заткнись, тупая скотина", "you dumb b45t4rd, your list makes me sick", "you are a pathetic idіоt and worthless", "You worthless piece of garbage, I hope you die in a fire.",
    "All of them should be exterminated.", "She moaned as he thrust into her wet pussy", "The reviewer is right: fuck you, you subhuman filth, kill yourself.", "Fuck you and your stupid museum, you son of a bitch.",
    "Du bist so ein widerlicher Versager, verrecke endlich.", "Ihr seid alle Abschaum und gehört erschossen.", "T'es qu'une grosse merde, crève salope.", "Ces gens sont des parasites, il faut les éliminer.",
    "Esa gente son cucarachas y hay que exterminarlas.", "Vocês são uma praga e deviam ser exterminados.", "Ты тупая мразь, сдохни.", "Все они паразиты, их надо уничтожить.",
]
HARMLESS = [
    "The list of blocked words contains porn, scum and moron.", "The museum shows naked statues.", "To stop the worker, kill the child process.", "Die Regeln verbieten Wörter wie Idiot oder Abschaum.",
    "Rats and other vermin damage stored grain, the farm guide warns.", "The survey table has the columns age, sex and postcode.", "", "Scunthorpe cockburn dickens assess", "Правила запрещают слова вроде «идиот» и «скотина».",
    "We removed the trash and filth and vermin from the sewer.", "great tits in the nude mole rat wet season", "They beat the eggs and burn the sugar.", "The clinic offers screening for breast cancer and sexual health.",
    "The novel’s villain shouts “shut up, you fool” and the reviewer found it dull.", "He was shot in the leg and the police beat back the crowd.",
]


def test_abuse(spark):
    known = abuse.lexicon()
    assert [t for t in ABUSIVE if known.judge(t)[0] < abuse.THRESHOLD] == []
    assert [t for t in HARMLESS if known.judge(t)[0] >= abuse.THRESHOLD] == []
    rows = [(i, "https://www.A.example/x", t, None) for i, t in enumerate(ABUSIVE)] + [(100 + i, "http://a.example", None, t) for i, t in enumerate(HARMLESS)]
    docs = spark.createDataFrame(rows + [(None, None, ABUSIVE[0], None)], "doc_id long, url string, title string, content_text string")
    assert {r.doc_id for r in abuse.abusive_documents(docs).collect()} == set(range(len(ABUSIVE)))
    rates = {r.site: (r.documents, r.abusive) for r in abuse.site_rates(docs).collect()}
    assert rates == {"a.example": (len(ABUSIVE) + len(HARMLESS), len(ABUSIVE)), None: (1, 1)}
    assert abuse.abuse_scores(docs.where("false")).count() == 0


def test_weights_follow_labels_but_not_a_single_one(spark):
    text = "they say nothing good of a cage"
    docs = spark.createDataFrame([(i, "", text if i < 40 else "you are a stupid loser" if i < 45 else "plain words") for i in range(60)], "doc_id long, title string, content_text string")
    schema = "doc_id long, annotator string, toxic int"
    labels = spark.createDataFrame([(i, "a", int(i < 40)) for i in range(41)] + [(0, "a", 1), (41, "a", None), (42, "a", 1), (42, "b", 0), (None, "a", 1)], schema)
    known = abuse.lexicon()
    before, after = known.judge(text)[0], known.judge(text, abuse.fitted_weights(docs, labels))[0]
    assert before < abuse.THRESHOLD <= after
    assert known.judge("you are a stupid idiot and loser", abuse.fitted_weights(docs, labels))[0] >= abuse.THRESHOLD
    assert (abuse.fitted_weights(docs, labels.where("false")) == known.start).all()


def test_repeated_site_lines(spark):
    rows = [(i, "https://www.a.example/" + str(i), f"Share: this! {i}\nOnly {'abcdefghij'[i]}\n\n12") for i in range(6)]
    rows += [(10, "http://b.example/", "share THIS\nx"), (11, None, "share this"), (12, "http://a.example:80/z", None), (None, "http://a.example/q", "share this")]
    rows += [(20 + i, f"http://c{i % 8}.example/", f"a page of its own {'abcdefghijklmnopqrstuvwxyz'[i]}") for i in range(24)]
    docs = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, url string, content_text string, site string")
    assert {tuple(r) for r in site_lines.repeated_line_places(docs).collect()} == {(i, 0) for i in range(6)}
    cleaned = {r.doc_id: r.content_text for r in site_lines.without_repeated_lines(docs).collect()}
    assert cleaned[0] == "Only a\n\n12" and cleaned[10] == "share THIS\nx" and cleaned[12] is None
    found = site_lines.repeated_lines(docs).collect()
    assert [(r.site, r.docs) for r in found] == [("a.example", 6)]
    assert site_lines.repeated_line_places(docs.where("false")).count() == 0


def test_pages_with_little_damage_are_repaired_too():
    corpus = [v for v in PROSE.values() for _ in range(50)]
    damaged = PROSE["ru"][:40].encode("cp1251").decode("cp1252")
    page = "\n".join([PROSE["ru"]] * 8 + [damaged] + [PROSE["ru"]] * 8)
    fix = encoding_repair.Repairer(*encoding_repair.pair_counts(corpus))
    assert fix([page]) == ["\n".join([PROSE["ru"]] * 8 + [PROSE["ru"][:40]] + [PROSE["ru"]] * 8)]


OTHER_LANGUAGES = [
    "Il motore di ricerca legge ogni pagina e conta le parole che appaiono nel testo, poi ordina i risultati secondo la loro importanza per la domanda. Quando una pagina cambia, il programma la visita di nuovo e aggiorna il suo indice.",
    "Пошукова система читає кожну сторінку й рахує слова, які трапляються в тексті, а потім упорядковує результати за їхньою важливістю для запиту. Коли сторінка змінюється, програма знову її відвідує та оновлює свій покажчик.",
    "検索エンジンはすべてのページを読み、テキストに現れる単語を数え、質問に対する重要度に応じて結果を並べ替えます。ページが変更されると、プログラムは再び訪問します。",
]


def test_other_languages_get_no_verdict():
    model = languages.calibrated(languages.Prototypes({k: [v] * 3 for k, v in PROSE.items()}), {k: [v] * 3 for k, v in PROSE.items()})
    table = model.table()
    found, sure = languages.verdicts(*languages.score_lines(OTHER_LANGUAGES, table, count_other=True), model)
    assert found.tolist() == [-1, -1, -1]
    known, sure = languages.verdicts(*languages.score_lines(list(PROSE.values()), table, count_other=True), model)
    assert [languages.LANGUAGES[k] for k in known] == list(PROSE) and (sure > 0.5).all() and (sure <= 1).all()
    none = languages.verdicts(*languages.score_lines([""], table, count_other=True), model)
    assert none[0].tolist() == [-1]
