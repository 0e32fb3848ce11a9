"""Secrets that stand inside the address they belong to."""

from emberline.llm import secrets

TOKEN = "aB3dE5gH7jK9mN1pQ3rS"


def test_redaction_of_secrets_in_their_endpoint(spark, docs_of):
    texts = {
        f"db: postgres://admin:{TOKEN}@db.example.com/x": "db: postgres://admin:<secret>@db.example.com/x",
        f"see https://host/v1?k={TOKEN}": "see https://host/v1?k=<secret>",
        f"see https://host/v1?a=b&k=x.{TOKEN}&c=d#e": "see https://host/v1?a=b&k=x.<secret>&c=d#e",
        f"see https://host.org/v1.{TOKEN}.html": None, f"see https://host/v1?{TOKEN}": None,
        f"see https://host/v1#k={TOKEN}": None, f"{TOKEN} alone": None,
    }
    out = {r.doc_id: r.text for r in secrets.redact_secrets(docs_of(list(enumerate(texts)))).collect()}
    assert out == {i: new or old for i, (old, new) in enumerate(texts.items())}
