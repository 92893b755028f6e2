"""Operators for preparing training text: counting, cleaning, deduplicating, placing and packing documents."""
