"""Query plans composed from the operators."""
