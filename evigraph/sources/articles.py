"""Article records out of XML answers: one row for each article or book chapter."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

ARTICLES = "file string, pmid string, title string, abstract string, authors array<string>, url string"


def _text(e: ET.Element | None) -> str:
    """All text inside, of inline elements too."""
    return "" if e is None else "".join(e.itertext())


def _author(a: ET.Element) -> str:
    given = a.findtext("ForeName") or a.findtext("Initials")
    return a.findtext("CollectiveName") or " ".join(x for x in (given, a.findtext("LastName"), a.findtext("Suffix")) if x)


def _articles(body: bytes) -> Iterator[tuple]:
    root = ET.fromstring(body)
    if (error := root.find(".//ERROR")) is not None:
        raise ValueError(error.text or "the service returned an error")
    for tag, inside, path in (("PubmedArticle", "MedlineCitation", "Article/"), ("PubmedBookArticle", "BookDocument", "")):
        for record in root.iter(tag):
            own = record.find(inside)
            pmid = "" if own is None else (own.findtext("PMID") or "").strip()
            if pmid.isdigit():
                abstract = " ".join(map(_text, own.findall(f"{path}Abstract/AbstractText"))).strip()
                authors = [n for n in map(_author, own.findall(f"{path}AuthorList/Author")) if n]
                yield pmid, _text(own.find(f"{path}ArticleTitle")), abstract, authors, f"https://pubmed.ncbi.nlm.nih.gov/{pmid}/"


def articles(files: DataFrame) -> DataFrame:
    """The articles of XML files (path, content as binary), parsed on the executors; numeric ids only, an error answer fails."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = [(f, *r) for f, body in zip(p["path"], p["content"], strict=True) for r in _articles(bytes(body))]
            yield pd.DataFrame(rows, columns=["file", "pmid", "title", "abstract", "authors", "url"])

    return files.select("path", "content").mapInPandas(run, ARTICLES)
