"""Calls of models behind one door: prompts, strict outputs, a cache, retries and a log. Clients are given, none is built in."""
