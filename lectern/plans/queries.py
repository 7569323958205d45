"""All registered queries (importing the modules registers them)."""

from lectern.plans import q_export, q_hierarchy, q_jobs, q_markup, q_push, q_records, q_scan, q_text, q_validate, q_workspace, q_xml  # noqa: F401
from lectern.plans.registry import ORACLE, QUERIES  # noqa: F401
