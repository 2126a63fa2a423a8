import pytest

from papyrine.llm import residue as R

BAD = """HTTP 503: service unavailable.
404 not found - the paper page you requested no longer exists.
Internal server error
Traceback (most recent call last):
KeyError: 'abstract'
Sorry, this page does not exist.
Seite nicht gefunden. Der gesuchte Beitrag liegt hier nicht.
Página no encontrada: el artículo pedido no está aquí.
Login required. Log in to see the full text.
Votre session a expiré, identifiez-vous de nouveau.
Access to this abstract is denied.
Just a second: we are verifying your browser. Reference b6b21d1218
You need to activate JavaScript to view the proceedings.
This app runs on scripts. Your browser blocks them, so nothing can be shown.
Veuillez autoriser JavaScript pour lire cet article.
We use cookies. Accept all / Reject all / Settings
Wartungsarbeiten: Die Seite ist derzeit nicht erreichbar.
This domain name is for sale.
Title: {{authors}}
{{ summary }}
Venue: <your keywords>
Abstract: @@year@@
Paper {0} by {1}, presented at {2}.
Title: undefined
Cited by NaN papers. Published undefined.
\\title{Your Title}
TBD TBD TBD
asdf asdf asdf
Your abstract goes here.
Texte à remplacer.
La sesión ha caducado.
Le service est momentanément indisponible, code 496.
Sie wurden abgemeldet.
Sorry, this page has been moved.
Cette page n'existe pas.
Diese Seite existiert nicht.
Demasiadas solicitudes desde su red.
TODO: write the abstract before the deadline!
Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor.
Loading… Loading…
Text extraction failed on page 418. No text layer.""".split("\n")

GOOD = """We count dead links: 404 answers made up 63 percent of the cited pages, access denied another 16 percent.
Pages that need JavaScript were rendered with scripts enabled before the waveform was cut to 39 tokens.
An internal server error is simulated by the molecule in 20 of the runs to test recovery.
Template engines replace a marker such as {{block}} at render time, and we measure how often a shard survives.
The value null stands for a missing divergence; undefined appears in 35 records of the log.
The prompt reads "Summarise {text} in {n} words", where text is the agent and n is 81.
Let $\\mathbf{x}_{i} \\in \\{0, 1\\}^{d}$ and write $\\hat{sensor}_{t}$ for its mean over 56 draws.
Our control prompt is plain lorem ipsum, so the horizon cannot use meaning; accuracy falls to 12 percent.
A TODO comment marks code left open; we mine environment comments from 29 projects.
"Log in to see the full text" is what 12 percent of the pages say.
Home | Papers | Authors | Search
Back to top
Previous paper | Next paper
Frente a la política, el error baja 23 puntos.
The server splits the field, and the click is predicted without a second page of text.
We use cookies of the browser game as rewards in 5 tasks and study the loss.""".split("\n")


@pytest.mark.parametrize("line", BAD)
def test_detected(line):
    assert R.is_residue(line)


@pytest.mark.parametrize("line", GOOD[:-1])
def test_left_alone(line):
    assert not R.is_residue(line)


# Ordinary sentences of papers, also as the only sentence of a text.
ORDINARY = """This paper does not assume convexity of the loss.
The paper is not about scaling laws.
The server does not see raw gradients.
This article was not peer reviewed.
Competing interests: none.
Error: 12.3% on the test set.
Very very very deep networks are hard to train.
Failed to open a second front, the method stalls.
Scheduled maintenance of power grids is an NP-hard problem.
Access restricted to employees is a limitation of this data.
Null results are rarely published.
This section contains proofs of both lemmas.
Loading data is slow.""".split("\n")


@pytest.mark.parametrize("line", ORDINARY)
def test_ordinary_sentences(line):
    assert not R.is_residue(line)


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, event_id long")


def test_documents(spark):
    p = spark.createDataFrame([(i, f"Title {i} on graphs", f"/virtual/{i}") for i in range(30)], "event_id long, title string, virtual_url string")
    prose = "We first fit a sparse policy, then the kernel is refined. It holds for all of them."
    rows = [(1, prose + "\n" + BAD[0] + "\n" + prose, "a", 1), (2, prose, "a", 2), (3, None, "a", 3), (4, "", None, None), (None, BAD[0], "a", 1), (5, BAD[0], None, None), (5, BAD[0], None, None), (6, prose * 2000 + "\n" + BAD[-1], "b", 4)]
    assert {r.doc_id for r in R.residue_documents(docs(spark, rows), p).collect()} == {1, 5, 6}
    assert R.residue_documents(docs(spark, rows).limit(0), p).count() == 0
    assert {r.doc_id for r in R.residue_documents(docs(spark, rows)).collect()} == {1, 5, 6}
    assert {r.doc_id for r in R.residue_documents(docs(spark, rows), p.limit(0)).collect()} == {1, 5, 6}


def test_evidence_of_unknown_wording(spark):
    """A response no detector knows is found where unrelated papers come with it."""
    p = spark.createDataFrame([(i, f"On sparse policies number {i}", None) for i in range(30)], "event_id long, title string, virtual_url string")
    line = "The page awaits a fresh login, code {}"
    assert not R.is_residue(line.format(4))
    rows = [(i, line.format(i), f"s{i % 3}", i) for i in range(8)] + [(50, "Our page on sparse policies has a login.", "s1", 3), (51, "This page has one login only here.", "s1", 4)]
    got = {r.doc_id: r.evidence for r in R.residue_documents(docs(spark, rows), p).collect()}
    assert got == {i: "duplicated" for i in range(8)}


def test_clashing_columns(spark):
    d = spark.createDataFrame([(1, BAD[0], "a", 1, "x", "y")], "doc_id long, text string, source string, event_id long, evidence string, skeleton string")
    assert R.residue_documents(d).first().doc_id == 1


def test_unknown_notice_of_another_language(spark):
    """A notice no word of which is known is found by duplication, in whole texts and in parts; quotes and furniture are not."""
    words = "graph policy kernel prior sensor reward loss index cache shard query token field layer".split()
    p = spark.createDataFrame([(i, f"On {words[i % 14]} models of {words[i % 13]}", f"/virtual/{i}") for i in range(400)], "event_id long, title string, virtual_url string")
    notice = "Ce fonds demeure clos aux lecteurs de passage."
    prose = lambda i: f"We fit the {words[i % 14]} before the {words[i % 11]} and the {words[i % 13]} is kept. Later the {words[i % 7]} grows with the {words[i % 12]}."
    rows = [(i, notice, f"h{i % 10}", i) for i in range(100)]
    rows += [(i, prose(i) + "\n" + notice + "\n" + prose(i + 3), f"h{i % 10}", i) for i in range(100, 200)]
    rows += [(i, prose(i) + "\n" + prose(i + 1) + "\nThis work is licensed under terms of the host.\nBack to top", f"h{i % 10}", i) for i in range(200, 300)]
    got = {r.doc_id: r.evidence for r in R.residue_documents(docs(spark, rows), p).collect()}
    assert got == {i: "duplicated" for i in range(200)}
    quoted = [(i, prose(i) + " " + notice + " " + prose(i + 3), f"h{i % 10}", i) for i in range(100)]
    assert R.residue_documents(docs(spark, quoted), p).count() == 0


def test_phrase_of_the_titles_is_no_response(spark):
    p = spark.createDataFrame([(i, "Sparse policies awaiting rewards", None) for i in range(30)], "event_id long, title string, virtual_url string")
    rows = [(i, "Sparse policies awaiting rewards are studied.", f"s{i % 3}", i) for i in range(20)]
    assert R.residue_documents(docs(spark, rows), p).count() == 0


def test_copies_of_one_text_are_one_paper(spark):
    text = "A body of its own.\nUnlike any other body."
    rows = [(i, text, f"s{i % 3}", None) for i in range(20)] + [(100 + i, text, f"s{i % 3}", 7) for i in range(20)]
    assert R.residue_documents(docs(spark, rows)).count() == 0


def test_evidence_labels(spark):
    rows = [(1, "Title: {{authors}}", "a", 1), (2, "Login required.", "a", 2), (3, "Seite nicht gefunden.", "a", 3), (4, "Seite nicht gefunden.", "b", 4)]
    assert {r.doc_id: r.evidence for r in R.residue_documents(docs(spark, rows)).collect()} == {1: "placeholder", 2: "wording", 3: "duplicated", 4: "duplicated"}
