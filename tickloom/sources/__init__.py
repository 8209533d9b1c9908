"""Readers and writers of bars, kline dumps and result tables."""
