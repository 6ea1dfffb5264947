"""Loads that go on as files arrive."""
