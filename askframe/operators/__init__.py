"""Relational operators: join discovery and analysis, plan-to-DataFrame builder, guards."""
