"""Operators over lines: parse, detect, plan, mint, apply, prove, recognise."""
