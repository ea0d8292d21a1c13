"""Finding contracts and products in nested enquiries, by criteria and by status.

A status is written as a text, an object or a list of them; unreadable enquiries have no contracts. Elements that aren't objects are passed over.
Criteria are met as by ``triples.contains``: member by member, ``ANY`` for any member or value.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame

from .nested import load_document
from .triples import _per_document, contains


def status_is(element: dict, wanted: str | None) -> bool:
    """Whether an element has a status, in any of its shapes. No wish, or "all", is always met; an element without status meets no other."""
    if wanted is None or wanted.lower() == "all":
        return True
    have = element.get("status") or element.get("statuses")
    if isinstance(have, str):
        return have == wanted
    return any(x.get("status") == wanted for x in ([have] if isinstance(have, dict) else have or []) if isinstance(x, dict))


def _objects(value: Any) -> Iterator[tuple[int, dict]]:
    for i, x in enumerate(value if isinstance(value, list) else [value]):
        if isinstance(x, dict):
            yield i, x


def products_of(contract: dict) -> Iterator[dict]:
    """The products of a contract, then those of its resources."""
    for _, p in _objects(contract.get("product")):
        yield p
    for _, r in _objects(contract.get("resources")):
        for _, p in _objects(r.get("products")):
            yield p


def offering_of(product: dict) -> str | None:
    """The external id of a product's offering, wherever it is written."""
    inner = product.get("productOffering")
    inner = inner if isinstance(inner, dict) else {}
    return product.get("productOfferingExternalId") or inner.get("productOfferingExternalId") or inner.get("productOfferingId")


def _text(v: Any) -> str | None:
    return v if v is None or isinstance(v, str) else json.dumps(v, ensure_ascii=False)


def find_contracts(docs: DataFrame, doc_id: str, data: str, search: dict | None = None, status: str | None = None) -> DataFrame:
    """``(doc_id, place, contract_id, n_products)`` of the contracts that meet ``search`` and ``status``."""

    def find(text: str) -> list[tuple]:
        doc, _ = load_document(text)
        return [(i, _text(c.get("id")), sum(1 for _ in products_of(c))) for i, c in _objects((doc or {}).get("contract")) if contains(c, search or {}) and status_is(c, status)]

    return _per_document(docs, doc_id, data, find, "doc_id long, place int, contract_id string, n_products int")


def find_products(docs: DataFrame, doc_id: str, data: str, search: dict | None = None, status: str | None = "ProductActive") -> DataFrame:
    """``(doc_id, contract, place, product_id, name, offering)`` of the products of all contracts that meet ``search`` and ``status``."""

    def find(text: str) -> list[tuple]:
        doc, _ = load_document(text)
        return [
            (i, n, _text(p.get("id")), _text(p.get("name")), _text(offering_of(p)))
            for i, c in _objects((doc or {}).get("contract"))
            for n, p in enumerate(products_of(c))
            if contains(p, search or {}) and status_is(p, status)
        ]

    return _per_document(docs, doc_id, data, find, "doc_id long, contract int, place int, product_id string, name string, offering string")
