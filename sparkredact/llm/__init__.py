"""Operators for preparing training corpora. Nothing else in sparkredact imports this package."""
