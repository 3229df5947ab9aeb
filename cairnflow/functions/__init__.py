"""Part of cairnflow."""
