"""The cache rules of the registered queries."""

from __future__ import annotations

from .operators.cache import Rule

RULES = [Rule("public.users", "user:{id}", "upsert", 60), Rule("public.orders", "order:{id}:{status}", "invalidate")]
