"""DuckDB oracle SQL for the registered queries.

Every statement starts from the driver's tables and spells the retail adapter
(see ``trolley.sources.testdata``) as a CTE, written independently of the Spark code:
the category rule here is the literal three-way CASE, the Spark side a folded lookup.
"""

from __future__ import annotations

ADAPTER = """
items AS (
  SELECT CAST(o_orderdate AS DATE) AS fecha,
         CAST(CASE o_orderkey % 4 WHEN 0 THEN 102 WHEN 1 THEN 103 WHEN 2 THEN 107 ELSE 110 END AS INTEGER) AS id_tienda,
         o_custkey AS id_cliente, l_partkey AS id_producto
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
product_category AS (
  SELECT p_partkey AS prod_id, CAST(substr(p_brand, 7) AS INTEGER) AS cat_id
  FROM part WHERE p_partkey % 10 <> 0),
categories AS (
  SELECT DISTINCT CAST(substr(p_brand, 7) AS INTEGER) AS cat_id, concat('CAT_', substr(p_brand, 7)) AS cat_name
  FROM part WHERE CAST(substr(p_brand, 7) AS INTEGER) <= 24),
flat0 AS (SELECT DISTINCT fecha, id_tienda, id_cliente, id_producto FROM items),
flat AS (
  SELECT f.fecha, f.id_tienda, f.id_cliente, f.id_producto,
         CAST(isodow(f.fecha) - 1 AS INTEGER) AS dia_semana,
         CAST(week(f.fecha) AS INTEGER) AS semana,
         CAST(month(f.fecha) AS INTEGER) AS mes,
         CASE WHEN pc.prod_id IS NOT NULL THEN coalesce(c1.cat_name, 'SIN CATEGORIA')
              ELSE coalesce(c2.cat_name, 'SIN CATEGORIA') END AS nombre_categoria
  FROM flat0 f
  LEFT JOIN product_category pc ON f.id_producto = pc.prod_id
  LEFT JOIN categories c1 ON pc.cat_id = c1.cat_id
  LEFT JOIN categories c2 ON f.id_producto = c2.cat_id)"""


def q(select: str, *ctes: str) -> str:
    """Adapter CTEs + extra CTEs + final statement."""
    parts = [ADAPTER] + [c.strip() for c in ctes]
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + select.strip()


def r(expr: str, digits: int) -> str:
    """SQL twin of ``functions.round_even``."""
    scale = float(10 ** digits)
    return f"(round_even(({expr}) * {scale}, 0) / {scale})"
