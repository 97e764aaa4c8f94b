import heldout
import pytest
from conftest import rows
from pyspark.sql import functions as F

from tidewell.llm import residue as R

SCHEMA = "doc_id bigint, text string, cells array<struct<cell_type: string, execution_count: int, start_char: int, end_char: int>>"


def documents(spark, docs):
    """docs: {id: [(kind, text), …]}"""
    data = []
    for i, cells in docs.items():
        text, places = "", []
        for kind, t in cells:
            if text:
                text += "\n\n"
            places.append((kind, None, len(text), len(text) + len(t)))
            text += t
        data.append((i, text, places))
    return spark.createDataFrame(data, SCHEMA)


PROSE = "We keep the tariff, merge the margin, and drop everything after row 235. Next we group the batch."

CASES = {
    "# {{ title }}": True, "Author: ${author_name}": True, "As before. #{any_name} Next we go on.": True, "<%= goal %>": True, "%%PROJECT_NAME%%": True, "@@DATE@@": True, "__COURSE__": True,
    "[[summary]]": True, "[Insert date here]": True, "[Titel hier einfügen]": True, "[AUTHOR NAME]": True, "Nada más. [TÍTULO] Y sigue.": True, "Ferro vestum dictum vita porta nunca, pellis felis ornam eros calida.": True, "Votre texte ici.": True, "<DATASET NAME>": True, "Date: {title}": True, "{resumen}": True,
    "Lorem ipsum dolor sit amet, vestum tempus lorem mollis dictum.": True, "foo bar foo bar foo bar foo bar": True, "blurb blurb blurb blurb blurb": True, "Paragraph 1. Filler filler filler.": True,
    "*Type your answer here, replacing this line.*": True, "Version: 1\n\nHeading goes here": True, "Hier steht Ihr Text.": True,
    "Home  Browse  Sign in\n\n502 Bad gateway. The renderer did not answer in time.\n\nHelp · Terms · Status": True,
    "<html><head><title>404 | This noteb</title></head><body><h1>404 | This notebook could not be found. It may have been moved or made private.</h1></body></html>": True,
    "<noscript>The notebook viewer does not work without JavaScript.</noscript>": True, "La sesión ha caducado. Inicie sesión de nuevo.": True, "Sorry, something went wrong on our side. Reload the page or try again later. Request ref 4fbfdc": True,
    "The template engine swaps `{{ meter }}` for the value of the meter; an unknown name stays empty.": False, "Set `<YOUR_KEY>` in the config to the key of your own account.": False,
    "Typesetters use lorem ipsum to judge a layout; our tariff counts how often such filler occurs in the sample.": False, "This lesson covers JavaScript charts: we enable zoom, bind the depot, and draw the margin.": False,
    "Pages that answered with error 404 were skipped, so the shelf has 12 rows fewer than the harbour.": False, "$$ \\frac{{x_{69}}}{{1 + y}} $$": False, "See [the docs](http://x/y) and [1].": False,
    'The server answers "Too many requests. Slow down and retry in 30 seconds." when a client asks too often.': False, "```\n{{ title }}\n```": False, "<b>bold</b> and **strong** and a_b_c": False, PROSE: False,
}


@pytest.mark.parametrize("kind", ["markdown", "raw"])
def test_residue_is_told_from_prose_about_it(spark, kind):
    docs = {i: [("markdown", PROSE), ("code", "x = 1"), (kind, text)] for i, text in enumerate(CASES)}
    found = {r[0] for r in rows(R.find_residue(documents(spark, docs)))}
    wrong = [t for i, t in enumerate(CASES) if (i in found) != CASES[t]]
    assert wrong == []


def test_code_and_output_never_count_and_documents_appear_once(spark):
    docs = {1: [("code", "print('{{ title }}')"), ("output", "404 This notebook could not be found. It may have been moved or made private.")], 2: [("markdown", "{{ a }}"), ("markdown", "{{ b }}"), ("raw", "lorem ipsum dolor sit amet")]}
    df = documents(spark, docs)
    assert rows(R.find_residue(df)) == [(2,)]
    assert rows(R.without_residue(df).select("doc_id")) == [(1,)]


def test_nulls_empties_long_cells_repeats_and_extra_columns(spark):
    long = (PROSE + "\n") * 3000 + "\nYour session has expired. Please sign in again to continue."
    df = documents(spark, {1: [("markdown", long)], 2: []})
    extra = spark.createDataFrame([(3, None, [("markdown", None, 0, 4)]), (4, "abc", None), (None, "{{ a }}", [("markdown", None, 0, 7)]), (5, "{{ a }}", [("markdown", None, None, 7), (None, None, 0, 7)])], df.schema)
    df = df.unionByName(extra).unionByName(df).withColumn("passage", F.lit("x")).withColumn("kind", F.lit("df"))
    assert rows(R.find_residue(df)) == [(1,)]
    assert rows(R.find_residue(df.limit(0))) == []


def test_a_repeated_unit_counts_in_a_long_mixed_cell(spark):
    many = " ".join(f"term{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(300))
    docs = {1: [("markdown", f"{many}\n\nblurb blurb blurb blurb blurb\n\n{many}")], 2: [("markdown", many)], 3: [("raw", f"{many}\nzork <b>zork</b> zork zork")], 4: [("markdown", f"{many}\n`blurb blurb blurb blurb`")]}
    assert rows(R.find_residue(documents(spark, docs))) == [(1,), (3,)]


def test_repeated_tags_do_not_hide_a_placeholder(spark):
    docs = {1: [("markdown", "<td></td><td></td>\n{{ title }}")], 2: [("raw", "<br><br><br><br>\n{{ title }}")], 3: [("markdown", "<td></td><td></td>\nplain words")]}
    assert rows(R.find_residue(documents(spark, docs))) == [(1,), (2,)]


def _lines(text):
    return [x for x in text.strip().split("\n") if x]


def test_wordings_held_out_by_family_and_language(spark):
    batches = {**{k: _lines(v) for k, v in heldout.FIRST.items()}, "second": _lines(heldout.SECOND), "third": _lines(heldout.THIRD), "fourth": _lines(heldout.FOURTH), "fifth": _lines(heldout.FIFTH)}
    residue = [x for v in batches.values() for x in v]
    prose = _lines(heldout.PROSE) + _lines(heldout.MORE_PROSE)
    exemplars = {x.lower() for s in (R.MESSAGES, R.PROMPTS, R.NAMED_FILLERS) for x in _lines(s)}
    shared = [x for x in residue if x.lower().rstrip(".!") in exemplars]
    residue = [x for x in residue if x not in shared]
    docs = {i: [("markdown", PROSE), ("markdown", x)] for i, x in enumerate(residue + prose)}
    found = {r[0] for r in rows(R.find_residue(documents(spark, docs)))}
    hits = sum(i in found for i in range(len(residue)))
    assert hits >= 0.9 * len(residue)
    assert hits >= 0.95 * len(found)  # precision, on prose that speaks of the same things
    for name, lines in batches.items():
        own = [i for i, x in enumerate(residue) if x in lines]
        assert sum(i in found for i in own) >= 0.8 * len(own), name


def test_patterns_have_no_greatest_length(spark):
    long = "_".join(["display", "name"] * 60)
    many = " ".join(["street", "address"] * 80)
    docs = {1: [("markdown", "{{ user." + long + " }}")], 2: [("markdown", f"[Your {many} goes here]")], 3: [("markdown", f'He wrote "{many} {{{{ title }}}} {many}" on it.')], 4: [("markdown", f"<img alt='{many * 9}'>plain words")]}
    assert rows(R.find_residue(documents(spark, docs))) == [(1,), (2,)]
