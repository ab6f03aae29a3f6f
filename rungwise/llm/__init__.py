"""Operators for preparing training text: tokens, archives, personal data, languages, duplicates,
quality, mixing and toxicity. Nothing else in the library imports this subpackage."""
