"""See the package README for the operators kept here."""
