from .ruleset import RuleSet, built_in

__all__ = ["RuleSet", "built_in"]
