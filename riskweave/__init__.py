"""Behavioural risk analytics on transaction ledgers, as Spark jobs."""
