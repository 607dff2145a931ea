"""DataFrame -> DataFrame operators over the name table and its reports."""
