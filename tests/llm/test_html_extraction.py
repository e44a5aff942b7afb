"""Extraction where marks mislead, names are of the subject, and every element has an id of its own."""

import random
import time
import tracemalloc

import pytest

from quern.llm import html_extraction as H

SF = "/root/testdata/sf0.01"


def words(w, n):
    return " ".join([w] * n)


@pytest.fixture(scope="module")
def weights(spark):
    return {"prior": H.Weights(), "trained": H.train(spark.read.parquet(f"{SF}/pages.parquet"))}


@pytest.mark.parametrize("which", ["prior", "trained"])
@pytest.mark.parametrize("cards", [1, 3, 6])
def test_teasers_marked_as_articles_do_not_empty_the_page(weights, which, cards):
    text = f"<div class='entry-content'><p>{words('first', 90)}</p><p>{words('second', 90)}</p></div>"
    cards = "<section class='teasers'>" + "".join(f"<article class='card'><h3>CARD {i}</h3></article>" for i in range(cards)) + "</section>"
    want = words("first", 90) + "\n\n" + words("second", 90)
    for page in (text + cards, cards + text):
        assert H.extract(f"<html><body><nav>Home</nav>{page}<footer>f</footer></body></html>", weights[which]) == want


@pytest.mark.parametrize("which", ["prior", "trained"])
def test_a_short_marked_article_is_still_the_article(weights, which):
    page = f"<body><div class='zq'>{words('other', 12)}</div><article><p>{words('real', 30)}</p></article><div class='zr'>{words('more', 12)}</div></body>"
    assert H.extract(page, weights[which]) == words("real", 30)


@pytest.mark.parametrize("which", ["prior", "trained"])
@pytest.mark.parametrize("name, stays", [("share-price-table", True), ("tags-explained", True), ("notice-period", True), ("share-buttons", False), ("related-posts", False), ("ad-slot-3", False), ("newsletter-signup", False), ("commentForm", False)])
def test_compound_names_in_a_marked_article(weights, which, name, stays):
    page = f"<body><article><p>{words('a', 60)}</p><div class='{name}'><p>{words('b', 20)}</p></div><p>{words('c', 60)}</p></article></body>"
    parts = [words("a", 60)] + ([words("b", 20)] if stays else []) + [words("c", 60)]
    assert H.extract(page, weights[which]) == "\n\n".join(parts)


@pytest.mark.parametrize("which", ["prior", "trained"])
def test_titles_in_headers_of_a_story_stay(weights, which):
    rest = f"<p>{words('text', 80)}</p>"
    want = "The title\n\n" + words("text", 80)
    for page in (
        f"<article><div class='post-header'><h1>The title</h1></div>{rest}</article>",
        f"<body><header><h1>Site</h1></header><div class='story'><header><h1>The title</h1></header>{rest}</div></body>",
        f"<body><div class='post'><div class='post-header'><h1>The title</h1></div>{rest}</div></body>",
    ):
        assert H.extract(page, weights[which]) == want, page
    assert H.extract(f"<body><header><h1>Site</h1></header><div class='body'>{rest}</div></body>", weights[which]) == words("text", 80)


def test_ids_of_single_elements_are_not_learned_one_by_one(spark):
    r = random.Random(1)
    own = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(9))
    rows = []
    for i in range(1500):
        inner = "".join(f"<div id='{own()}' class='{own()}'><p>{words('word', 8)}</p></div>" for _ in range(30))
        rows.append((i, "u", f"<body><div class='rail-x'><p>{words('side', 9)}</p></div><article>{inner}</article></body>"))
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(8)
    H.train(df.limit(40))  # loads what is loaded once
    tracemalloc.start()
    began = time.time()
    w = H.train(df)
    assert time.time() - began < 60 and tracemalloc.get_traced_memory()[1] < 200e6
    tracemalloc.stop()
    assert len(w.around) < len(H.PRIOR) + 50 and w.around[".rail-x"] < -0.1
    assert H.extract(rows[3][2], w) == "\n\n".join([words("word", 8)] * 30)


def test_few_marked_pages_are_all_learned_from(spark):
    rows = [(i, "u", f"<body><div class='zq-rail'><p>{words('x', 5)}</p></div>" + (f"<article><p>{words('y', 30)}</p></article>" if i % 50 == 0 else f"<p>{i}</p>") + "</body>") for i in range(1500)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    w = H.train(df, limit=100)  # 30 are marked: a share of all pages would leave two
    assert ".zq-rail" in w.around and w.around[".zq-rail"] < 0


def test_fit_is_what_dense_regression_gives():
    import numpy as np

    r = random.Random(2)
    names = [f".n{i}" for i in range(12)] + ["<p", ".sidebar"]
    seen = {(tuple(sorted(r.sample(names, r.randint(0, 5)))), r.randint(0, 1)): r.randint(1, 50) for _ in range(80)}
    w = H.Weights.fit(seen, {("p", 0): 3, ("p", 1): 30})
    used = sorted({x for k, _ in seen for x in k})
    X = np.array([[float(x in k) for x in used] + [1.0] for k, _ in seen])
    y, n = np.array([c for _, c in seen], float), np.array(list(seen.values()), float)
    n, prior = n / n.sum(), np.array([H.PRIOR.get(x, 0.0) for x in used] + [0.25])
    v = prior.copy()
    rate = 1 / (0.25 * (n[:, None] * X * X.sum(1, keepdims=True)).sum(0) + 2e-4)
    for _ in range(400):
        v -= rate * (X.T @ (n * (1 / (1 + np.exp(-X @ v)) - y)) + 2e-4 * (v - prior))
    assert np.allclose([*(w.around[x] for x in used), w.bias], v, atol=1e-9)
