"""Bars and features of streams, by bounded-history recomputation."""
