"""DataFrame operators for yield panels and gridded weather tables."""
