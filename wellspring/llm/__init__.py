"""Operators for preparing training text (see README, section ``llm``)."""
