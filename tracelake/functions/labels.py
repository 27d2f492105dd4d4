"""Column functions that word, count and hash: labels, fixes, tokens, digests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The vocabulary of node types.
CALLS, ROUTES, MODELS = ("frontend", "frontend_component"), ("route", "api_route"), ("model", "schema_model")
CHARS_PER_TOKEN = 3.8


def estimate_tokens(text: Column) -> Column:
    """A token for each 3.8 characters, at least one; none for empty text."""
    return tokens_of_length(F.length(F.coalesce(text, F.lit(""))))


def tokens_of_length(length: Column) -> Column:
    return F.when(length == 0, F.lit(0)).otherwise(F.greatest(F.lit(1), F.floor(length / F.lit(CHARS_PER_TOKEN)))).cast("long")


def edge_label(relation: Column, confidence: Column, exact: Column) -> Column:
    """C8"""
    sure = F.coalesce(confidence, F.lit(1.0))
    return (
        F.when(relation == "relates_to", F.lit("[RELATION]"))
        .when(relation == "accesses", F.lit("[ORM]"))
        .when((sure >= 0.99) | F.coalesce(exact, F.lit(False)), F.format_string("%.1f [STATIC]", sure))
        .when(sure >= 0.8, F.format_string("%.2f [TEMPLATE]", sure))
        .otherwise(F.format_string("%.2f [PARAM]", sure))
    )


def suggested_fix(rule: Column, message: Column) -> Column:
    """Which remedy fits a problem, by the first rule that applies."""
    rule, message = F.coalesce(rule, F.lit("")), F.coalesce(message, F.lit(""))
    return (
        F.when(rule.contains("schema-attribute-missing") | message.contains("does not exist on model"), F.lit("declare the attribute on the model or stop using it"))
        .when(rule.contains("unmatched-fetch-route") | message.contains("does not match any registered"), F.lit("register the route or correct the path of the call"))
        .when(F.lower(rule).contains("type") | F.lower(message).contains("type"), F.lit("bring request and response types in line"))
        .otherwise(F.lit("inspect the place and bring both sides of the contract in line"))
    )


def content_hash(content: Column) -> Column:
    """C10"""
    return F.sha2(content, 256)


def node_label(node_type: Column, path: Column, line: Column, method: Column, route: Column, symbol: Column, table: Column) -> Column:
    """The short name of a node by its type."""
    return (
        F.when(node_type.isin(*CALLS), F.format_string("[UI] %s (L%d)", F.element_at(F.split(path, "/"), -1), line))
        .when(node_type.isin(*ROUTES) & method.isin("MCP_TOOL", "MCP_RESOURCE"), F.concat(F.lit("[MCP] "), symbol))
        .when(node_type.isin(*ROUTES), F.concat_ws(" ", F.lit("[API]"), method, route))
        .when(node_type.isin(*MODELS), F.concat(F.lit("[DB] "), symbol, F.lit(" ("), F.coalesce(table, F.lower(symbol)), F.lit(")")))
        .otherwise(symbol)
    )


def node_level(node_type: Column) -> Column:
    """Tier 1 for calls, 2 for routes, 3 for models."""
    return F.when(node_type.isin(*CALLS), F.lit(1)).when(node_type.isin(*MODELS), F.lit(3)).otherwise(F.lit(2))
