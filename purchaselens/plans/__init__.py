"""Choices of physical plan that Catalyst cannot make alone, and the template registry."""
