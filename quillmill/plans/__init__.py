"""Helpers that shape plans: shared scratch tables, distributed prefix sums."""
