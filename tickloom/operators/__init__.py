"""Operators on bars, signals, returns, trades and their reconciliation."""
