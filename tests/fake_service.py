"""A stand-in for the bibliographic service, which workers import by name."""

import json


def answer(address, fields):
    """Stands for the service: 450 ids, of which every fetch gives the records asked for, and the list of the fields it got."""
    if fields.get("term") == "((":
        return json.dumps({"esearchresult": {"ERROR": "Invalid query"}})
    if address.endswith("esearch.fcgi"):
        return json.dumps({"esearchresult": {"count": "450", "idlist": [str(n) for n in range(450, 0, -1)][: int(fields["retmax"])]}})
    ids = fields["id"].split(",")
    assert len(ids) <= 200 and fields["api_key"] == "k"
    body = "".join(f"<PubmedArticle><MedlineCitation><PMID>{i}</PMID><Article><ArticleTitle>T{i}</ArticleTitle></Article></MedlineCitation></PubmedArticle>" for i in reversed(ids) if i != "7")
    return f"<PubmedArticleSet>{body}</PubmedArticleSet>"
