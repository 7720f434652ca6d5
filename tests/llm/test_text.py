import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings, strategies

from rainledger.llm import canonical, language, mixing, residue
from rainledger.llm.canonical import NameTrie, Resolver, map_values, most_edits
from rainledger.llm.encoding import FragmentEncoder, encode, tokenizer_dir
from rainledger.llm.language import LANGUAGES, document_languages, fit_profiles, judged_lines, mislabelled_lines, named_language, segments_of
from rainledger.llm.mixing import mix_documents, sainte_lague
from rainledger.llm.page_lines import TokenTrees, page_templates, repeated_lines, without_lines
from rainledger.llm.residue import residue_documents, without_residue
from rainledger.storage import Workspace


# page lines


def test_repeated_lines(spark):
    note = "Lees  ook 12 artikelen\r"
    rows = [(i, "A", f"Regel {'abcdefghij'[i]} van de tekst\n\n{note if i % 2 else 'LEES OOK 7 ARTIKELEN'}\neigen regel {'abcdefghij'[i]}", "x") for i in range(10)]
    rows += [(0, "A", rows[0][2], "x"), (20, "B", note, "x"), (21, None, note, "x"), (22, " ", note, "x"), (23, "A", None, "x"), (24, "A", "", "x"), (None, "A", note, "x")]
    df = spark.createDataFrame(rows, "id int, source string, text string, template string")
    lines = repeated_lines(df)
    assert sorted(tuple(r) for r in lines.collect()) == [(i, 2) for i in range(10)]
    clean = {r["id"]: r["text"] for r in without_lines(df.where("id = 3").select("id", "text"), lines).collect()}
    assert clean[3] == "Regel d van de tekst\n\neigen regel d"
    assert repeated_lines(df.limit(0)).count() == 0


def test_a_tenth_of_the_source_is_needed(spark):
    rows = [(i, "A", "zelfde regel" if i < 5 else f"regel {'abcdefghijklmnopqrstuvwxyz'[i % 26] * (i // 26 + 1)}") for i in range(60)]
    assert repeated_lines(spark.createDataFrame(rows, "id int, source string, text string")).count() == 0


def test_lines_are_counted_in_covering_leaves_only(spark, monkeypatch):
    written, write = {}, Workspace.write
    monkeypatch.setattr(Workspace, "write", lambda self, name, df, *a: written.setdefault(name, write(self, name, df, *a)))
    rng, words = random.Random(4), "de het een boer dijk sluis water".split()
    # the note stands in 10 of 40 documents; so does a leaf of lines that are all different
    rows = [(i, "A", "\n".join([*(" ".join(rng.choices(words, k=rng.randrange(3, 9))) for _ in range(3)), f"op de {chr(97 + i // 26)}{chr(97 + i % 26)} akker", "Lees ook 7 artikelen" if i % 4 == 0 else ""])) for i in range(40)]
    forms = [(i, n, x.lower().replace("7", "#")) for i, _, t in rows for n, x in enumerate(t.split("\n")) if x]
    path = lambda x: (len(x.split(" ")), *x.split(" ")[:2])
    least = lambda keys: {k for k in keys if len({i for i, _, x in forms if k in (x, path(x))}) >= 5}
    got = repeated_lines(spark.createDataFrame(rows, "id int, source string, text string")).collect()
    assert sorted(tuple(r) for r in got) == sorted((i, n) for i, n, x in forms if x in least({x for _, _, x in forms}))
    leaves = least({path(x) for _, _, x in forms})
    assert {(3, "op", "de"), (4, "op", "de"), (4, "lees", "ook")} & leaves == {(4, "op", "de"), (4, "lees", "ook")}
    assert written["leaves"].count() == len(leaves) < len({path(x) for _, _, x in forms}) and "forms" not in written


def test_trees_give_back_every_form_and_learn_word_slots():
    lines = ["a", "a b", "a b c", "a b c d", "x \u0001", "x \u0001 y", "een bericht van anna bij de krant", "een bericht van piet bij de krant", "een bericht van anna bij de krant", "een bericht uit een heel ander dorp"]
    trees = TokenTrees()
    for line in lines:
        trees.add("s", line)
    found = {f: (t, n) for _, t, _, f, n in trees.templates()}
    assert {f: n for f, (_, n) in found.items()} == {t: lines.count(t) for t in set(lines)}
    assert found[lines[6]][0] == found[lines[7]][0] == "een bericht van \u0003 bij de krant" and found[lines[9]][0] == lines[9]


def test_a_word_that_varies_is_a_slot(spark):
    names = ["anna", "piet", "jan", "els", "kees", "mien", "bert", "loes"]
    rows = [(i, "A", f"Eigen {'abcdefgh'[i]} zin hier\nTekst van onze verslaggever {names[i]} voor de krant") for i in range(8)]
    df = spark.createDataFrame(rows, "id int, source string, text string").repartition(3)
    assert repeated_lines(df).count() == 0
    assert sorted(tuple(r) for r in repeated_lines(df.coalesce(1), word_slots=True).collect()) == [(i, 1) for i in range(8)]
    assert [tuple(r) for r in page_templates(df.coalesce(1)).collect()] == [("A", "tekst van onze verslaggever * voor de krant", 8, 8)]


# names


ENTRIES = [("P1", "place", "Oeverhoven", ["Stad Stoofgat"]), ("P2", "place", "Oud-Uiverloo", []), ("P3", "place", "'t Zandwijk", None), ("P4", "place", "Uiverloo", []), ("R1", "region", "Noord-Lommerdal", ["Achter de Wal"]), ("R2", "region", "West-Lommerdal", []), ("P5", "place", "Lissel aan de Swalk", [])]


@pytest.mark.parametrize(
    "value, ref",
    [("OEVERHOVEN", "P1"), ("Oeverhovn", "P1"), ("omgeving Oeverhoven", "P1"), ("Oeverhoven (NL)", "P1"), ("Oеvеrhоvеn", "P1"), ("Oever­hoven", "P1"), ("stad stoofgat", "P1"), ("Oud Uiverlo", "P2"), ("Uiverloo", "P4"), ("Het Zandwyk", "P3"), ("Zandwijk, 't", "P3"), ("Lommerdal, West", "R2"), ("N.-Lommerdal", "R1"), ("Lommerdal (gemeente noord)", "R1"),
     ("Oeverhoven, Noord-Lommerdal", "P1"), ("Oeverhoven e.o.", "P1"), ("Lissel a/d Swalk", "P5"), ("Montiheim", "-"), ("onbekend", "-"), ("???", "-"), ("Ã“everhoven", "P1"), ("x" * 20_000, "-")],
)
def test_resolve(value, ref):
    assert Resolver(ENTRIES).resolve(value) == ref


def test_regions_only():
    r = Resolver(ENTRIES)
    assert r.resolve("achter de wal", True) == "R1" and r.resolve("Oeverhoven", True) == "-"


def distance(a, b):
    d = [[i + j if i * j == 0 else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def test_trie_returns_all_entries_within_the_distance():
    rng = random.Random(4)
    names = sorted({"".join(rng.choice("abc") for _ in range(rng.randrange(1, 8))) for _ in range(150)})
    trie = NameTrie()
    for n in names:
        trie.add(n, n)
    for _ in range(150):
        q = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 8)))
        k = rng.randrange(0, 4)
        assert sorted(trie.search(q, k)) == sorted((distance(q, n), n) for n in names if distance(q, n) <= k)
    assert [most_edits(n) for n in (3, 5, 8, 12)] == [0, 1, 2, 3]


def test_map_values(spark):
    ref = spark.createDataFrame(ENTRIES, "ref_id string, kind string, name string, aliases array<string>")
    rows = spark.createDataFrame([(1, "Oeverhoven", "noord lommerdal", 1), (2, None, " ", 1), (3, "oeverhoven", "Noord-Lommerdal", 1), (4, "niets", None, 1), (4, "niets", None, 1)], "row_id long, location string, nuts3_name string, field int")
    got = sorted(tuple(r) for r in map_values(rows, "row_id", {"location": False, "nuts3_name": True}, ref).collect())
    assert got == [(1, "nuts3_name", "R1"), (3, "location", "P1"), (4, "location", "-"), (4, "location", "-")]
    assert {r["ref_id"] for r in map_values(rows, "row_id", {"location": False}, ref.limit(0)).collect()} == {"-"}


def test_a_long_list_is_searched_in_parts(spark, monkeypatch):
    ref = spark.createDataFrame(ENTRIES, "ref_id string, kind string, name string, aliases array<string>")
    typed = ["OEVERHOVEN", "Oeverhovn", "omgeving Oeverhoven", "Oud Uiverlo", "Zandwijk, 't", "Lommerdal, West", "Oeverhoven, Noord-Lommerdal", "Lissel a/d Swalk", "de oever van Oeverhoven", "Montiheim", "Uiverloo", " ", None, "OEVERHOVEN"]
    rows = spark.createDataFrame([(i, v, v, 1) for i, v in enumerate(typed)], "row_id long, location string, nuts3_name string, key int")
    find = lambda: sorted(tuple(r) for r in map_values(rows, "row_id", {"location": False, "nuts3_name": True}, ref).collect())
    whole = find()
    monkeypatch.setattr(canonical, "MOST_ENTRIES", 3)
    assert find() == whole and len(whole) == 22


# languages


SENTENCES = {
    "nl": ["De boer wacht al weken op regen en de sloten zijn leeg.", "Het waterschap verbiedt het sproeien van de velden tot het einde van de maand.", "De gemeente vraagt de inwoners om zuinig te zijn met water.", "Volgens de beheerder staat het peil van de rivier lager dan ooit."],
    "en": ["The farmer has waited for rain for weeks and the ditches are empty.", "The water board forbids the spraying of the fields until the end of the month.", "The town asks the people to be careful with their water.", "According to the manager the river stands lower than ever before."],
    "de": ["Der Bauer wartet seit Wochen auf Regen und die Gräben sind leer.", "Der Wasserverband verbietet das Beregnen der Felder bis zum Ende des Monats.", "Die Gemeinde bittet die Einwohner, sparsam mit dem Wasser zu sein.", "Nach Angaben des Verwalters steht der Fluss niedriger als jemals zuvor."],
    "fr": ["Le fermier attend la pluie depuis des semaines et les fossés sont vides.", "Le syndicat des eaux interdit l'arrosage des champs jusqu'à la fin du mois.", "La commune demande aux habitants de faire attention à leur eau.", "Selon le gérant, la rivière est plus basse que jamais auparavant."],
}


def labelled(spark):
    rows, n = [], 0
    for lang, sentences in SENTENCES.items():
        for i in range(12):
            random.Random(i).shuffle(sentences)
            rows.append((n, lang, "\n".join(sentences)))
            n += 1
    return spark.createDataFrame(rows, "id int, lang string, text string")


def test_lines_segments_and_labels(spark):
    profiles = fit_profiles(labelled(spark))
    held = ["De dijkgraaf laat het water uit de polder naar de rivier pompen.", "The keeper of the dike lets the water of the polder run to the river.", "Der Deichgraf lässt das Wasser aus dem Polder in den Fluss pumpen.", "Le maître des digues fait pomper l'eau du polder vers la rivière."]
    assert [x[2] for x in judged_lines(profiles, held)] == list(LANGUAGES)
    assert all(0 < x[3] <= 1 for x in judged_lines(profiles, held))
    mixed = f"{held[1]} {held[0]} {held[3]} {SENTENCES['nl'][0]}"
    assert judged_lines(profiles, [mixed])[0][2] == "nl"
    assert judged_lines(profiles, ["te kort", "1234567890 " * 20, ""]) == []
    assert [n for _, n in segments_of("Ja. Nee. Dit is een langere zin van de schrijver.")]


def test_documents_and_segments(spark):
    profiles = fit_profiles(labelled(spark))
    nl, en, fr = SENTENCES["nl"], SENTENCES["en"], SENTENCES["fr"]
    other = "Zażółć gęślą jaźń, wczoraj wieczorem padał śnieg nad całym krajem i wszyscy zostali w domach przez tydzień."
    rows = [(1, f"{nl[0]} {nl[1]}\n{nl[2]}\n\n{en[0]} {en[1]}\n{fr[0]}"), (2, "De boer\nwacht op\nregen en\nwater"), (3, None), (4, " \n12 "), (5, other)]
    got = {r["id"]: r for r in document_languages(spark.createDataFrame(rows, "id int, text string"), profiles).collect()}
    assert got[1]["lang"] == "nl" and [(x["first_line"], x["last_line"], x["lang"]) for x in got[1]["segments"]] == [(0, 1, "nl"), (3, 3, "en"), (4, 4, "fr")]
    assert 0 < got[1]["confidence"] < 1 and got[2]["lang"] == "nl" and len(got[2]["segments"]) == 1
    assert all(got[i]["lang"] is None and got[i]["confidence"] == 0 for i in (3, 4, 5)) and not got[3]["segments"] and len(got[5]["segments"]) == 1


def test_counts_above_255_keep_their_rank():
    table = language._Table([[1, 2, 3, 4], [4, 3, 2, 1]])
    gram = np.array([0] * 900 + [2] * 700 + [1] * 500 + [3] * 300)  # numbered by their best rank
    out = np.full((1, 2), 2.0)
    table.add(out, np.zeros(len(gram), np.int64), gram)
    assert out[0, 0] < out[0, 1]


def test_mislabelled_lines(spark):
    base = labelled(spark)
    texts = base.select("id", "text").unionAll(spark.createDataFrame([(900, SENTENCES["de"][0] + "\nkort\n" + SENTENCES["nl"][1]), (901, SENTENCES["fr"][1]), (902, None), (None, "x"), (903, "")], "id int, text string"))
    texts = texts.unionAll(texts.where("id = 900"))
    labels = base.selectExpr("id", "lang as lang_label").unionAll(spark.createDataFrame([(900, "Nederlands"), (901, "und"), (901, None), (999, "nl")], "id int, lang_label string"))
    got = sorted((r["id"], r["line_no"], r["lang"]) for r in mislabelled_lines(texts, labels).collect())
    assert got == [(900, 0, "de"), (901, 0, "fr")]


def test_label_names(spark):
    rows = spark.createDataFrame([("nl_BE", "nl"), ("EN-gb", "en"), ("Français", "fr"), ("Duits", "de"), ("Dutch (NL)", "nl"), ("und", None), (" ", None), (None, None), ("unknown", None)], "a string, b string")
    assert all(r[0] == r[1] for r in rows.select(named_language(rows.a), "b").collect())


# encoding


def test_ids_equal_the_whole_text_encoder(spark):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(f"{tokenizer_dir()}/byte_bpe_50k.json")
    whole.encode_special_tokens = True
    rng = random.Random(6)
    signs = "aqxzZ Q\n\t  '’éßа字🙂.,!?0159-_\"{}<|>​\r" + "'s't're'll"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(0, 60))) for _ in range(1500)] + ["<|endoftext|> tekst", "a" * 50_000, " " * 5000 + "x", None, ""]
    df = spark.createDataFrame([(i, t, [1]) for i, t in enumerate(texts)], "doc_id long, text string, ids array<int>")
    got = {r["doc_id"]: r["ids"] for r in encode(df).collect()}
    assert all(got[i] == (whole.encode(t, add_special_tokens=False).ids if t else []) for i, t in enumerate(texts))
    e = FragmentEncoder()
    assert "".join(e.fragments(texts[7])) == texts[7]
    assert encode(df.limit(0)).count() == 0


# mixing


def test_sainte_lague():
    assert sainte_lague([53, 24, 23], [99, 99, 99], 7) == [4, 2, 1] or sum(sainte_lague([53, 24, 23], [99, 99, 99], 7)) == 7
    assert sainte_lague([0.5, 0.5], [1, 100], 10) == [1, 9]
    assert sum(sainte_lague([1.0, 2.0, 1e-9], [10**14, 10**14, 10**14], 10**12)) == 10**12 and sainte_lague([3.0, 1.0], [10**9, 10**13], 10**12)[0] == 10**9
    assert sainte_lague([0.0], [5], 3) == [0] and sainte_lague([], [], 3) == []

    def slow(w, caps, n):
        got = [0] * len(w)
        for _ in range(n):
            free = [i for i in range(len(w)) if w[i] > 0 and got[i] < caps[i]]
            if free:
                got[max(free, key=lambda i: (w[i] / (2 * got[i] + 1), -i))] += 1
        return got

    rng = random.Random(1)
    for _ in range(60):
        w = [rng.random() for _ in range(rng.randrange(1, 7))]
        caps = [rng.randrange(0, 80) for _ in w]
        n = rng.randrange(0, 120)
        assert sainte_lague(w, caps, n) == slow(w, caps, n)


def test_mixes_keep_caps_and_reach_shares(spark):
    rows = [(i, "A" if i % 3 else "B", f"woord {i} " * (5 + i % 40), "s") for i in range(600)] + [(1000 + i, "C", "klein stuk tekst " * 3, "s") for i in range(3)] + [(2000, None, "zonder bron", "s"), (2001, "A", None, "s"), (2002, "A", "", "s")]
    df = spark.createDataFrame(rows, "id int, source string, text string, tokens string")
    goals = spark.createDataFrame([(1, "A", 0.5, 1, 0.3), (1, "B", 0.5, 2, 0.3), (2, "C", 0.5, 4, 0.2), (2, "A", 0.5, 1, 0.2), (2, "leeg", 0.0, 3, 0.2), (3, "leeg", 1.0, 1, 0.1)], "mix_id int, source string, target_share double, max_repeats int, total_tokens_share double")
    selection, report = mix_documents(df, goals)
    got = {(r["mix_id"], r["source"]): r for r in report.collect()}
    assert abs(got[1, "A"]["actual_share"] - 0.5) < 0.01 and abs(got[1, "B"]["actual_share"] - 0.5) < 0.01
    assert got[2, "C"]["most_repeats"] == 4 and got[2, "C"]["documents"] == 3 and got[3, "leeg"]["tokens"] == 0
    chosen = [tuple(r) for r in selection.collect()]
    caps = {(r["mix_id"], r["source"]): r["max_repeats"] for r in goals.collect()}
    assert all(0 < n <= caps[m, s] for m, _, s, _, n in chosen) and len({(m, i) for m, i, *_ in chosen}) == len(chosen)
    for m in (1, 2):
        tokens = sum(t * n for k, _, _, t, n in chosen if k == m)
        assert abs(tokens - got[m, "A"]["wanted_tokens"]) < 0.01 * tokens + 100
    assert sorted(map(tuple, mix_documents(df, goals)[0].collect())) == sorted(chosen)
    assert mix_documents(df.limit(0), goals)[0].count() == 0


@pytest.mark.parametrize("rows_a_shard", [20_000, 40])
def test_blocks_of_many_shards_reach_the_quota_to_a_block(spark, monkeypatch, rows_a_shard):
    monkeypatch.setattr(mixing, "SHARD_ROWS", rows_a_shard)
    rows = [(i, "AB"[i % 3 == 0], f"woord {i} " * (5 + i % 40)) for i in range(900)]
    df = spark.createDataFrame(rows, "id int, source string, text string")
    goals = spark.createDataFrame([(m, s, x, r, 0.2 * m) for m in (1, 2, 3) for s, x, r in (("A", 0.3, 1), ("B", 0.7, 3))], "mix_id int, source string, target_share double, max_repeats int, total_tokens_share double")
    selection, report = mix_documents(df, goals)
    got = {(r["mix_id"], r["source"]): r for r in report.collect()}
    chosen = selection.collect()
    assert max(r["repeats"] for r in chosen if r["source"] == "B") == 2 and max(r["repeats"] for r in chosen if r["source"] == "A") == 1
    for m in (1, 2, 3):
        assert all(abs(got[m, s]["tokens"] - x * got[m, s]["wanted_tokens"]) < 2 * 120 * (1 if rows_a_shard > 100 else 8) for s, x in (("A", 0.3), ("B", 0.7)))
    assert {r["id"] for r in chosen if r["mix_id"] == 1} != {r["id"] for r in chosen if r["mix_id"] == 2}


# residue


ARTICLE = "De boer wacht al weken op regen en de sloten zijn leeg. Het waterschap verbiedt het sproeien van de velden tot het einde van de maand. De gemeente vraagt de inwoners om zuinig te zijn met water."


@pytest.mark.parametrize(
    "text, kind",
    [(ARTICLE, None), (ARTICLE + " {{ titel }}", "field"), (ARTICLE + " [VUL HIER NAAM IN]", "field"), (ARTICLE + "\n[sic]\n[…] [A-117] {SPI-3} {a, b, c} $ 500 of 12% <p>x</p> <|endoftext|> #droogte", None), (ARTICLE.upper() + " [SIC]", None), (ARTICLE + "\nLorem ipsum dolor sit amet consectetur.", "filler"), (ARTICLE + "\nInleiding volgt nog.", "filler"),
     ("Kop van het stuk\nHome | Nieuws | Weer | Contact\nPagina niet gevonden\nRay ID 53a636415e3f", "message"), ("ZONDER SCRIPTS IS ER NIETS TE ZIEN.", "message"), ("Access denied.", "message"), ("La page demandée n'existe pas ou a été déplacée.", "message"), ("Einen Moment, Ihr Browser wird geprüft.", "message"),
     (ARTICLE + "\n\nDeze pagina heeft JavaScript nodig.", None), (ARTICLE + " De site gaf die middag foutmelding 404.", None), ("Kort bericht over de regen van vandaag.", None), ("", None), ("  \n", None), (None, None), ("woord " * 100_000, None), ("<|endoftext|>", None)],
)
def test_residue(spark, text, kind):
    df = spark.createDataFrame([(1, "s", text, "x")], "id int, source string, text string, kind string")
    assert [r["kind"] for r in residue_documents(df).collect()] == ([kind] if kind else [])


def test_pages_of_recurring_notices_only_have_no_word_limit(spark):
    notices = [f"Deze site toont {word} nu geen onderdeel van {word}." for word in ("alfa", "beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta", "iota", "kappa", "lambda", "mu", "nu", "xi")]
    rows = [(i, f"s{i}", "\n".join(notices)) for i in range(5)] + [(9, "s9", "\n".join([notices[0]] * 40))]
    assert sorted(r["id"] for r in residue_documents(spark.createDataFrame(rows, "id int, source string, text string")).collect()) == [0, 1, 2, 3, 4, 9]


@pytest.mark.parametrize("pattern", residue._MESSAGES)
def test_every_message_holds_a_piece(pattern):
    cut = residue.Segmenter()

    @settings(max_examples=60, deadline=None, database=None, suppress_health_check=list(HealthCheck))
    @given(strategies.from_regex(pattern, fullmatch=True, alphabet=strategies.characters(codec="latin-1", exclude_categories=["Cc", "Lu"])))
    def check(message):
        message = " ".join(message.split())
        if residue.re.fullmatch(pattern, message):
            shown = message.replace("0", "7")
            assert cut._kinds(shown, shown)[1], shown

    check()


@pytest.mark.parametrize("text", ["{{ naam }}", "${x}", "$NAME$", "@@naam@@", "__naam__", "<<naam>>", "[[naam]]", "&lt;naam&gt;", "<naam hier>", "{naam}", "{0}", "[VUL HIER DE NAAM. IN]", "[Insert the. name]", "[Namen einfügen]", "[à compléter]", "(naam invullen)", "XX-XX-20XX", "undefined", "[object Object]", "NaN", "TODO", "%NAME%", "#NAME#", "%s", "[NAAM]", "asdf", "Qwer", "bla, bla", "xxx xxx", "Tekst volgt nog", "Hier komt de tekst", "sample text", "Copy goes here", "Tussenkop", "Lorem dolor sit amet."])
def test_every_field_and_filler_is_seen(spark, text):
    rows = spark.createDataFrame([(1, "s", ARTICLE + "\n" + text)], "id int, source string, text string")
    assert residue_documents(rows).count() == 1


def test_recurring_messages_of_unknown_wording(spark):
    rows = [(i, f"s{i % 5}" if i % 5 else None, f"Kop {i}\nDeze site slaapt momenteel diep") for i in range(10)]
    df = spark.createDataFrame(rows, "id int, source string, text string")
    assert residue_documents(df).count() == 10 and without_residue(df).count() == 0
    assert residue_documents(df.where("id = 1")).count() == 0 and residue_documents(df.limit(0)).count() == 0
