"""The registered queries and the SQL that each is held against."""

from probatum.plans import analysis, annexes, checks, compliance, documents, external, governance, papers, people
from probatum.plans.queries import ORACLE, QUERIES, flagship

__all__ = ["ORACLE", "QUERIES", "analysis", "annexes", "checks", "compliance", "documents", "external", "flagship", "governance", "papers", "people"]
