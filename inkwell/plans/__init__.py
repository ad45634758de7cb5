from .pipeline import RuleConfig, optimize, optimize_requests, reject_blank, rules_table  # noqa: F401
