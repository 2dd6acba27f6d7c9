"""DataFrame operators that know nothing about one particular report."""
