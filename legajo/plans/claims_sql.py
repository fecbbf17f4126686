"""SQL text shared by the twins of the claims-view queries."""

from __future__ import annotations

from legajo.fixed_values import ALLOWED_FIELDS, FIELD_TYPE_PRIORITIES, PRIORITY_PROFILES
from legajo.plans.bindings import CLAIM_FIELDS, CLAIM_TYPES

_KIND = "CASE l_partkey % 6 " + " ".join(
    f"WHEN {i} THEN '{t}'" for i, t in enumerate(CLAIM_TYPES)
) + " END"

_VALUES = {
    "numero_siniestro": "lpad(CAST(l_orderkey AS VARCHAR), 14, '0')",
    "nombre_asegurado": "concat('CUSTOMER ', CAST(o_custkey AS VARCHAR))",
    "numero_poliza": "concat('POL-', CAST(l_suppkey AS VARCHAR))",
    "monto_reclamacion": (
        "CASE WHEN l_returnflag = 'A' THEN NULL "
        "ELSE CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR) END"
    ),
    "fecha_ocurrencia": "CAST(CAST(l_shipdate AS DATE) AS VARCHAR)",
    "fecha_reclamacion": "CAST(CAST(o_orderdate AS DATE) AS VARCHAR)",
}

DOCUMENTS = f"""WITH docs AS MATERIALIZED (
  SELECT CAST(l_orderkey AS VARCHAR) AS case_id, l.*, o_custkey, o_orderdate,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey,
             l_quantity, l_extendedprice, l_shipdate) AS ordinal,
         concat('doc_', l_linenumber, '_', l_partkey, '_', l_suppkey, '_',
                CAST(l_extendedprice AS DECIMAL(18,2)), '.pdf') AS source_document,
         {_KIND} AS document_type
  FROM lineitem l JOIN orders ON l_orderkey = o_orderkey)"""

_CELLS = ", ".join(
    f"{{'field_order': {i}, 'field': '{f}', 'value': {_VALUES[f]}}}"
    for i, f in enumerate(CLAIM_FIELDS)
)
ALL_CELLS = DOCUMENTS + f""",
cells AS MATERIALIZED (SELECT case_id, ordinal, source_document, document_type, c.field_order, c.field, c.value
  FROM (SELECT case_id, ordinal, source_document, document_type, unnest([{_CELLS}]) AS c FROM docs))"""


def _allowed() -> str:
    listed = ", ".join(f"'{t}'" for t in ALLOWED_FIELDS)
    pairs = ", ".join(
        f"('{t}', '{f}')" for t, fields in ALLOWED_FIELDS.items() for f in fields
    )
    return f"(document_type NOT IN ({listed}) OR (document_type, field) IN ({pairs}))"


def _rank(profile: str) -> str:
    if profile == "yaml":
        whens = " ".join(
            f"WHEN field = '{f}' AND document_type = '{t}' THEN {i}"
            for f, kinds in FIELD_TYPE_PRIORITIES.items()
            for i, t in enumerate(kinds, 1)
        )
        return f"CASE {whens} ELSE 99 END"
    whens = " ".join(f"WHEN '{t}' THEN {p}" for t, p in PRIORITY_PROFILES[profile].items())
    return f"CASE document_type {whens} ELSE 99 END"


def OPTIONS(profile: str) -> str:  # noqa: N802
    return ALL_CELLS + f""",
options AS MATERIALIZED (SELECT *, {_rank(profile)} AS priority FROM cells
            WHERE value IS NOT NULL AND {_allowed()})
"""


def DECIDED(profile: str) -> str:  # noqa: N802
    return OPTIONS(profile) + """,
placed AS MATERIALIZED (SELECT *, count(*) OVER (PARTITION BY case_id, field) AS n_options,
                  row_number() OVER (PARTITION BY case_id, field ORDER BY priority, ordinal) AS place
           FROM options),
decided AS (SELECT case_id, field, value, source_document, n_options,
    CASE WHEN n_options = 1 THEN 1.0 ELSE 0.9 END::DOUBLE AS confidence,
    CASE WHEN n_options = 1 THEN concat('Único valor de ', source_document)
         ELSE concat('Seleccionado de ', source_document, ' (', document_type,
                     ') por mayor prioridad') END AS reasoning
  FROM placed WHERE place = 1)
"""
