"""The rule catalogue, row rules, cross-row rules and where issues are shown."""
